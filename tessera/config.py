"""Settings of the engine, with environment overrides, and the enumerations of the data model."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# The enumerations of the data model, in order.
KINDS = (
    "user_prompt", "normalized_query", "assistant_answer", "routing_decision", "decision_trace", "topic_pattern", "research_plan",
    "search_query", "evidence_summary", "research_report", "research_finding", "user_profile_note", "decision_outcome", "training_example",
)
SCOPES = ("session", "user", "global")
STATUSES = ("active", "superseded", "deleted")
CONFIDENTIALITIES = ("private", "restricted", "shareable")
MODES = ("assistant", "planner", "research", "drafting")
TARGETS = ("local", "hosted")
IMPORT_EXTENSIONS = (".txt", ".md", ".rst", ".csv", ".json", ".yaml", ".yml", ".log", ".html", ".htm", ".xml", ".ndjson")

PREFIX = "TESSERA_"


# The defaults of Settings, and the defaults and limits of Request.


@dataclass(frozen=True)
class Settings:
    """Defaults of all operators; from_env() reads TESSERA_<FIELD> for each field, blank meaning the default."""

    retention_days: int = 45
    max_records_per_scope_kind: int = 24
    stale_research_report_days: int = 60
    stale_assistant_answer_days: int = 14
    stale_topic_pattern_days: int = 30
    stale_user_profile_note_days: int = 120
    query_top_k: int = 6
    chunk_chars: int = 900
    chunk_overlap_chars: int = 120
    include_global_scope_by_default: bool = True
    include_user_scope_by_default: bool = True
    dedup_threshold: float = 0.85
    dedup_lookback: int = 10
    decay_start_pct: float = 0.5
    training_export_enabled: bool = True
    embedding_backend: str = "hashing"
    embedding_dimensions: int = 384
    onnx_model_path: str = ""
    onnx_tokenizer_path: str = ""
    semantic_candidate_multiplier: int = 4
    lexical_candidate_multiplier: int = 4
    semantic_score_weight: float = 0.6
    lexical_score_weight: float = 0.25
    keyword_bonus_weight: float = 0.08
    metadata_bonus_weight: float = 0.07

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper(), "").strip()
            if raw:
                kind = type(f.default)
                given[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**given)

    @property
    def group_limit(self) -> int:
        return max(4, self.max_records_per_scope_kind)

    @property
    def window(self) -> tuple[int, int]:
        """Length of a chunk and distance between the starts of two."""
        size = max(300, self.chunk_chars)
        return size, size - max(0, min(self.chunk_overlap_chars, size // 2))


@dataclass(frozen=True)
class Request:
    """A retrieval request. Empty lists mean no restriction; None for a scope switch means the setting's default."""

    query_text: str
    session_id: str | None = None
    user_id: str | None = None
    model_target: str = "local"
    enforce_policy: bool = True
    include_user_scope: bool | None = None
    include_global_scope: bool | None = None
    kinds: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    content_classes: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    source_keys: tuple[str, ...] = ()
    confidentialities: tuple[str, ...] = ()
    source_statuses: tuple[str, ...] = ()
    limit: int | None = None
    max_age_days: int | None = None
    token_budget: int = 1200
    assembly_mode: str = "assistant"
    intent_json: str | None = None
    intent_schema: dict | None = None

    def __post_init__(self):
        checks = (
            (self.model_target in TARGETS, "model_target"),
            (self.assembly_mode in MODES, "assembly_mode"),
            (self.limit is None or 1 <= self.limit <= 100, "limit"),
            (50 <= self.token_budget <= 12000, "token_budget"),
            (self.max_age_days is None or self.max_age_days >= 1, "max_age_days"),
            (set(self.confidentialities) <= set(CONFIDENTIALITIES), "confidentialities"),
            (set(self.source_statuses) <= set(STATUSES), "source_statuses"),
            (set(self.kinds) <= set(KINDS), "kinds"),
        )
        for good, name in checks:
            if not good:
                raise ValueError(f"{name} is out of range: {getattr(self, name)!r}")

    def top(self, settings: Settings) -> int:
        return max(1, self.limit or settings.query_top_k)

    def filters(self) -> dict[str, list[str]]:
        """The filters as an audit row shows them."""
        named = ("kinds", "source_types", "content_classes", "tags", "source_keys", "confidentialities", "source_statuses")
        out = {"model_target": [self.model_target], "enforce_policy": [str(self.enforce_policy).lower()]}
        return out | {n: list(getattr(self, n)) for n in named if getattr(self, n)}
