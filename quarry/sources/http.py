"""Fetching pages: a provider with pauses, retries and conditional headers."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd

FETCHED = "url string, status int, content_type string, etag string, last_modified string, content binary, error string"


def open_url(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    """(status, lower-case headers, body) of a GET request."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


@dataclass(frozen=True)
class Fetcher:
    """A provider for ``files.provided``: rows (url, etag, last_modified) to FETCHED.

    A page that hasn't changed has status 304 and no content.  Failed requests and server
    errors are tried again after a pause; what fails in the end has an error and no content.
    Each task has its own pace, so the pause is a task's, not the cluster's: deal a host's
    urls to one partition to keep its limit.
    """

    delay: float = 0.7
    jitter: float = 0.25
    backoff: tuple[float, ...] = (1.0, 2.5, 4.0)
    timeout: float = 30.0
    headers: dict[str, str] = field(default_factory=dict)
    get: Callable[[str, dict[str, str], float], tuple[int, dict[str, str], bytes]] = open_url
    sleep: Callable[[float], None] = time.sleep

    def fetch(self, url: str, etag: str | None = None, modified: str | None = None) -> tuple:
        headers = dict(self.headers)
        if etag:
            headers["If-None-Match"] = etag
        if modified:
            headers["If-Modified-Since"] = modified
        error = "no attempt"
        for pause in self.backoff:
            self.sleep(self.delay + random.uniform(0, self.jitter))
            try:
                status, got, body = self.get(url, headers, self.timeout)
            except Exception as e:  # whatever a connection raises is a failed attempt
                error = f"{type(e).__name__}: {e}"
            else:
                if status < 400 or status == 404:
                    content = body if status < 300 else None
                    return url, status, got.get("content-type"), got.get("etag"), got.get("last-modified"), content, None if status < 400 else "HTTP 404"
                error = f"HTTP {status}"
                if status < 500 and status != 429:
                    break
            self.sleep(pause)
        return url, None, None, None, None, None, error

    def __call__(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FETCHED.split(", ")]
        for rows in parts:
            got = [self.fetch(r.url, getattr(r, "etag", None), getattr(r, "last_modified", None)) for r in rows.itertuples()]
            out = pd.DataFrame(got, columns=names)
            out["status"] = out["status"].astype("Int32")
            yield out
