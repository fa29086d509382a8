"""Evidence analytics on Spark: chunking, retrieval, reconciliation, review and data-quality operators."""

from quaysift.config import EngineConfig

__all__ = ["EngineConfig"]
