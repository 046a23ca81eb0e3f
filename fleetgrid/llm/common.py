"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A word, in the contracts that split at ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def marks(text_col: str) -> dict[str, Column]:
    """Two hashes of a text (null counts as empty), which tell rows apart whose ids are null or repeated."""
    text = text_or_empty(text_col)
    return {"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(7), text)}


#: Copies of a row that are laid out by one task.
COPIES = 4096


def laid_out(counted: DataFrame, copies: str, nth: str) -> DataFrame:
    """Each row as often as its column ``copies`` says, with its number ``nth`` from 0. A row with many copies is laid out by many tasks."""
    few = counted.filter(F.col(copies) <= COPIES).withColumn(nth, F.explode(F.expr(f"sequence(0L, {copies} - 1)")))
    many = counted.filter(F.col(copies) > COPIES)
    if many.isEmpty():
        return few.drop(copies)
    first = many.withColumn("_first", F.explode(F.expr(f"sequence(0L, {copies} - 1, {COPIES}L)")))
    dealt = first.repartition(F.xxhash64(*first.columns))
    return few.unionByName(dealt.withColumn(nth, F.explode(F.expr(f"sequence(_first, least(_first + {COPIES}, {copies}) - 1)"))).drop("_first")).drop(copies)


def without(df: DataFrame, id_col: str, text_col: str, gone: DataFrame, once: DataFrame) -> DataFrame:
    """``df`` without the rows in ``gone`` and with one of each in ``once``; both have distinct ``_id, _h1, _h2`` (see marks)."""
    marked = df.withColumns(marks(text_col))
    same = lambda rows, keys: rows[id_col].eqNullSafe(keys["_id"]) & (rows["_h1"] == keys["_h1"]) & (rows["_h2"] == keys["_h2"])
    kept = marked.join(gone, same(marked, gone), "left_anti")
    if not once.isEmpty():
        single = kept.join(once, same(kept, once), "left_semi").dropDuplicates([id_col, "_h1", "_h2"])
        kept = kept.join(once, same(kept, once), "left_anti").unionByName(single)
    return kept.select(*df.columns)


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``most`` (one row at least)."""
    start = total = at = 0
    for at, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, at
            start, total = at, 0
    if start < at:
        yield start, at
