"""Settings: frozen dataclasses, each field an environment variable with a default. The names and defaults are fixed values."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from typing import get_type_hints


def _cast(kind, text: str):
    if kind is bool:
        return text == "1"
    if kind == tuple[str, ...]:
        return tuple(text.split(","))
    return kind(text)


class FromEnvironment:
    """``X.load()`` takes each field from the variable of its upper-cased, prefixed name."""

    PREFIX = ""

    @classmethod
    def load(cls, env: dict[str, str] | None = None):
        env = os.environ if env is None else env
        hints = get_type_hints(cls)
        given = {f.name: _cast(hints[f.name], env[key]) for f in fields(cls) if (key := f"{cls.PREFIX}{f.name}".upper()) in env}
        return cls(**given)


@dataclass(frozen=True)
class CollectConfig(FromEnvironment):
    feeds_file: str = "/data/feeds/allowlist_feeds.json"
    recent_days: int = 3
    time_budget_sec: int = 300
    min_items: int = 10
    request_timeout: int = 15
    max_retries: int = 3


@dataclass(frozen=True)
class EnrichConfig(FromEnvironment):
    PREFIX = "ENRICHER_"

    global_concurrency: int = 4
    per_domain_concurrency: int = 1
    per_domain_qps: float = 0.5
    http_timeout_sec: int = 20
    http_max_retries: int = 3
    user_agent: str = "Mozilla/5.0 (compatible; docmill)"
    follow_redirects: bool = True
    prefer_ipv4: bool = True
    extractor_sequence: tuple[str, ...] = ("trafilatura", "readability", "newspaper3k", "goose3", "article", "main", "page")
    min_accept_words: int = 200
    allow_amp_print_variants: bool = True
    max_full_text_chars: int = 50_000
    min_full_text_chars: int = 1000
    respect_paywalls: bool = True
    lang_allowlist: tuple[str, ...] = ("en",)
    force: bool = False


@dataclass(frozen=True)
class RetrieveConfig(FromEnvironment):
    PREFIX = "RAG_"

    #: Empty: the hashed stand-in.
    embedding_model: str = ""
    chunk_size: int = 400
    chunk_overlap: float = 0.15
    k_ann: int = 300
    k_bm25: int = 200
    k_merge: int = 500
    alpha_lexical: float = 0.25
    mmr_lambda: float = 0.30
    final_limit: int = 30
    per_query_cap: int = 8
    queries_file: str = "queries.json"


@dataclass(frozen=True)
class ScriptConfig(FromEnvironment):
    PREFIX = "SCRIPT_"

    speaker_names: tuple[str, ...] = ("Adam", "Sara")
    target_total_secs: int = 480
    max_lines_per_item: int = 8
    max_words_per_line: int = 100
    default_pause_ms: int = 120
    segment_prefix: str = "SEG_"
    allow_consecutive_speaker: bool = True
    digits_to_speech: bool = True
    spell_acronyms: bool = True
    wpm_estimate: int = 150
    show_name: str = ""


@dataclass(frozen=True)
class ModelConfig(FromEnvironment):
    """The text model that a caller's client asks; the stages take the client itself."""

    PREFIX = "OPENAI_"

    model: str = "gpt-4o-mini"
    max_tokens: int = 128


@dataclass(frozen=True)
class PolishConfig(FromEnvironment):
    PREFIX = "POLISH_"

    pace: str = "medium"
    tone: str = "warm, clear, no slang"
    enable_micro_transitions: bool = True
    enable_ssml: bool = False
    lock_segment_boundaries: bool = True
    allow_merge_lines: bool = True
    allow_split_lines: bool = True
    enforce_balance: bool = True
    balance_tolerance_pct: float = 10.0
