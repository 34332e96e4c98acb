"""Stable short hashes as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_hash(source_dir: Column, source_index: Column, target_dir: Column, target_index: Column, model: str) -> Column:
    """OP-HASH-01."""
    name = F.concat(source_dir, F.lit(":"), source_index.cast("string"), F.lit("→"), target_dir, F.lit(":"), target_index.cast("string"), F.lit(f":{model}"))
    return F.left(F.sha2(name, 256), F.lit(8))


def suggestion_hash(canonical: Column, members: Column) -> Column:
    """OP-HASH-02: the members' order doesn't matter."""
    listed = F.array_join(F.array_sort(F.transform(members, F.lower)), ",")
    return F.left(F.sha2(F.concat(F.lower(canonical), F.lit(":"), listed), 256), F.lit(8))
