"""All constants of the engine in one immutable object."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Limits and thresholds; every operator takes them from here or as an argument."""

    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 5
    rerank_candidates: int = 20
    embed_batch_size: int = 16
    embed_max_retries: int = 5
    embed_dim: int = 768
    rrf_k: int = 60
    max_pages_per_pdf: int = 25
    max_text_chars: int = 60000
    evidence_chars: int = 1500
    confidence_threshold: float = 0.7
    max_agent_rounds: int = 2
    relative_tolerance: float = 0.01
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    cost_per_1k_tokens: float = 0.00015
    job_ttl_sec: int = 86400
    job_timeout_sec: int = 1800
    strict_embed: bool = field(default_factory=lambda: os.environ.get("STRICT_EMBED", "") == "1")
    tokenizer_dir: str = field(default_factory=lambda: os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"))


DEFAULT = EngineConfig()
