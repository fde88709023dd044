"""stonefly: a Spark-first relational engine with versioned tables."""

from stonefly.session import Engine

__all__ = ["Engine"]
