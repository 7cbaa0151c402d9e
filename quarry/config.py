"""Defaults of the engine's operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes, caps and weights; operators take single values, plans take the whole."""

    #: Host of the document site, without www.
    site: str = "docs.example.org"
    #: Host endings that rank higher, with their bonus; the site itself has the first.
    site_bonus: float = 0.35
    trusted: tuple[tuple[str, float], ...] = (("gov.uz", 0.20), (".uz", 0.10))
    language: str = "uz"

    chunk_words: int = 350
    chunk_overlap: int = 60
    passage_words: int = 150
    passage_overlap: int = 20

    top_k: int = 15
    candidate_multiplier: int = 6
    candidate_cap: int = 200
    per_document: int = 3

    fts_k: int = 8
    fts_per_document: int = 2
    fts_candidates: int = 60
    title_weight: float = 6.0
    text_weight: float = 1.0
    recency_weight: float = 0.3
    recency_base_year: int = 2020

    alpha: float = 0.7
    mmr_lambda: float = 0.7
    mmr_pool: int = 15
    mmr_output: int = 8
    stage1_docs: int = 10
    final_n: int = 5
    final_per_document: int = 2
    per_domain: int = 2
    context_chars: int = 32_000
    block_chars: int = 1_200
    #: Characters of a text that a model reads; None: whole texts.
    embed_chars: int | None = None

    min_words: int = 120
    min_unique: int = 60
    min_unique_ratio: float = 0.15
    max_common_line: float = 0.25
    weak_ocr_words: int = 80

    poll_days: int = 2
    docs_per_run: int = 15
    rechecks_per_run: int = 6
    recheck_days: int = 21
    error_retry_days: int = 3


#: Queue priorities by reason.
PRIORITY = {"calendar": 3, "backfill": 2, "recheck": 1}
