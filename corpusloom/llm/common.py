"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed as cut
from corpusloom.session import release, remove, shared_folder, table

__all__ = ["cut", "fold", "fresh", "release", "remove", "shared_folder", "table"]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}{k}"
    return name


def fold(label_mod: int, doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, modulo ``label_mod``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(label_mod))
