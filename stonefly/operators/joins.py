"""Five join types on three algorithms, chosen by hint; without a hint Spark and AQE choose."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame


class JoinType(Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"
    CROSS = "cross"


class InvalidJoinCondition(ValueError):
    pass


def _keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> Column:
    if not left_keys or len(left_keys) != len(right_keys):
        raise InvalidJoinCondition("a join by key needs as many left as right keys, and one at least")
    return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in zip(left_keys, right_keys, strict=True)])


def nested_loop_join(left: DataFrame, right: DataFrame, how: JoinType, condition: Column | None = None) -> DataFrame:
    """Any condition, or none. It compares all pairs, so it is for small sides."""
    if how is JoinType.CROSS:
        if condition is not None:
            raise InvalidJoinCondition("a cross join has no condition")
        return left.crossJoin(right)
    if condition is None:
        raise InvalidJoinCondition(f"a {how.value} join needs a condition")
    return left.join(right, condition, how.value)


def hash_join(left: DataFrame, right: DataFrame, how: JoinType, left_keys: Sequence[str], right_keys: Sequence[str], condition: Column | None = None) -> DataFrame:
    """Equality keys plus an optional residual. Shuffled by key; AQE still makes it a
    broadcast when the measured side is under the session's threshold."""
    if how is JoinType.CROSS:
        raise InvalidJoinCondition("a hash join needs keys")
    on = _keys(left, right, left_keys, right_keys)
    return left.join(right.hint("shuffle_hash"), on if condition is None else on & condition, how.value)


def merge_join(left: DataFrame, right: DataFrame, how: JoinType, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Equality keys only, both sides sorted; spills, so it takes sides of any size."""
    if how is JoinType.CROSS:
        raise InvalidJoinCondition("a merge join needs keys")
    return left.join(right.hint("merge"), _keys(left, right, left_keys, right_keys), how.value)


def join_using(left: DataFrame, right: DataFrame, names: Sequence[str], how: JoinType = JoinType.INNER) -> DataFrame:
    """USING: the named columns appear once."""
    return left.join(right, list(names), how.value)


def natural_join(left: DataFrame, right: DataFrame, how: JoinType = JoinType.INNER) -> DataFrame:
    """NATURAL: USING of all columns that both sides have; without any it is a cross join, as in SQL."""
    shared = [c for c in left.columns if c in set(right.columns)]
    return join_using(left, right, shared, how) if shared else left.crossJoin(right)
