"""Texts of PDF files and scans: a small text layer reader, and providers in order."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterable

STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT(?:[jJdDm]\b|\*)|'|\"|\bET\b|-?\d+(?:\.\d+)?|\[|\]")
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Marks of check boxes that recognition adds.
SELECTION = re.compile(r":(?:un)?selected:")


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def value(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r") else ESCAPED.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", value, token[1:-1], flags=re.S)


def text_layer(content: bytes) -> str:
    """The text that a PDF's pages show with simple fonts, one line for each text line.

    Plain and Flate streams; fonts with their own encodings need a real library, which is
    a provider like this one.  What is no PDF gives an empty text.
    """
    if not content.startswith(b"%PDF"):
        return ""
    lines: list[str] = []
    for head, body in STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        line = b""
        held: list[bytes] = []
        for token in SHOWN.findall(body):
            if token[:1] in (b"(", b"<"):
                held.append(_literal(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"') and line:
                    lines.append(line.decode("cp1252", "replace"))
                    line = b""
                line += b"".join(held)
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                if line:
                    lines.append(line.decode("cp1252", "replace"))
                line, held = b"", []
            elif re.fullmatch(rb"-\d+(\.\d+)?", token) and held and float(token) < -200:
                held.append(b" ")  # a wide gap between shown parts is a space
        if line:
            lines.append(line.decode("cp1252", "replace"))
    return "\n".join(x.strip() for x in lines if x.strip())


def first_text(content: bytes, extractors: Iterable[Callable[[bytes], str | None]]) -> str | None:
    """The first extractor's text that isn't blank; one that fails is passed over."""
    for extract in extractors:
        try:
            text = extract(content)
        except Exception:  # a broken file must not end the batch
            continue
        if text and text.strip():
            return text
    return None


def recognised(pages: Iterable[bytes], recognise: Callable[[bytes], str], most: int | None = None) -> str:
    """Texts of page images by a local recogniser, ``most`` pages at most; bad pages are skipped."""
    out = []
    for i, page in enumerate(pages):
        if most is not None and i >= most:
            break
        try:
            out.append(recognise(page))
        except Exception:  # a bad page must not lose the others
            continue
    return "\n".join(x.strip() for x in out if x and x.strip())


def polled(content: bytes, submit: Callable[[bytes], str], poll: Callable[[str], tuple[str, str | None]], *, timeout: float = 90.0, every: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Text of a remote recogniser: submit gives a job, poll its state and text; null if it fails or lasts too long."""
    job, end = submit(content), clock() + timeout
    while clock() < end:
        state, text = poll(job)
        if state == "succeeded":
            return SELECTION.sub("", text or "").strip()
        if state == "failed":
            return None
        sleep(every)
    return None
