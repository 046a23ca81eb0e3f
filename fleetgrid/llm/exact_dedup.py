"""Exact dedup by progressive refinement: normalised length, then a prefix hash, then a full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, marks, text_or_empty, without

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _refine(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each row with ``peers``, the number of rows that share its key.

    The counts are cut off from the rows they came from, so that the join deals out both sides anew and
    adaptive execution can split a key that holds many rows; so is the result, which is read more than once, lest
    the next counts be taken inside the partitions of this key, without adding up before the shuffle.
    """
    counts = durable(rows.groupBy(*key).agg(F.count("*").alias("peers")).filter("peers > 1"))
    return durable(rows.join(counts, key, "left"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical without ASCII white space. Of equal texts the row with the most code
    points in the original text stays, then the smallest id (null ids come last). Null texts count as empty, and
    all empty texts are equal. Of repeated rows (same id, same text) one alone is kept; each counts in
    ``group_size``. An empty table gives an empty result. Other columns are ignored.

    The refinement: rows alone with their normalised length need no hash, nor do rows alone with their length and
    prefix hash; for the rest the texts are read again, and their full hashes joined to the rows that are left. ``digest_all`` is for a caller that
    wants ``text_sha256`` of every row: then the one scan takes the digest too and nothing is read twice; without it
    that column is null for rows that needed no full hash.
    """
    decided = _decided(df, id_col, text_col, digest_all)
    id_type = df.schema[id_col].dataType
    return decided.select(*(F.col(c).cast(id_type) if c in ("doc_id", "keep_id") else F.col(c) for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")))


def _decided(df: DataFrame, id_col: str, text_col: str, digest_all: bool = False, marked: bool = False) -> DataFrame:
    """The columns of exact_groups, and with ``marked`` the marks of each row."""
    own = [*marks(text_col)] if marked else []
    norm = normalised(F.col("_text"))
    source = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"), *(marks(text_col)[k].alias(k) for k in own)).withColumn("_norm", norm)
    prefix = F.xxhash64(F.substring("_norm", 1, PREFIX))
    scan = source.select(
        "doc_id",
        *own,
        F.length("_text").alias("points"),
        F.length("_norm").alias("len"),
        prefix.alias("prefix"),
        *([F.sha2(F.col("_norm").cast("binary"), 256).alias("sha")] if digest_all else []),
    )
    narrow = durable(scan)

    by_length = _refine(narrow, ["len"])
    lone = by_length.filter("peers is null").drop("peers")
    by_length = by_length.filter("peers is not null").drop("peers")
    by_prefix = _refine(by_length, ["len", "prefix"])
    lone = lone.unionByName(by_prefix.filter("peers is null").drop("peers"))
    left = by_prefix.filter("peers is not null").drop("peers")
    if not digest_all:
        ids = durable(left.select(F.col("doc_id").alias("_id"), F.col("len").alias("_len"), F.col("prefix").alias("_prefix")).distinct())
        again = source.select("doc_id", *own, F.length("_text").alias("points"), F.length("_norm").alias("len"), prefix.alias("prefix"), F.sha2(F.col("_norm").cast("binary"), 256).alias("sha"))
        left = again.join(ids, F.expr("doc_id <=> _id and len = _len and prefix = _prefix"), "left_semi")
        lone = lone.withColumn("sha", F.lit(None).cast("string"))

    # repeated rows become one with a count, so that one of them alone is kept
    rows = durable(left.groupBy("doc_id", *own, "points", "len", "prefix", "sha").agg(F.count("*").alias("copies")))
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("back"), "doc_id", *own))
    groups = durable(rows.groupBy("len", "prefix", "sha").agg(F.sum("copies").alias("group_size"), best.alias("best")))
    dealt = rows.join(groups, ["len", "prefix", "sha"])
    keeper = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("points") == F.col("best.points"))
    for k in own:
        keeper = keeper & (F.col(k) == F.col(f"best.{k}"))
    grouped = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (keeper & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), *own
    )
    alone = lone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), *own)
    return alone.unionByName(grouped)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without all but one of each group of equal texts; its columns stay as they are.

    Rows are told apart by their id and text together, so ids may be null or repeated; rows that repeat both become one.
    """
    key = [F.col("doc_id").alias("_id"), *marks(text_col)]
    decided = _decided(df, id_col, text_col, marked=True).filter("group_size > 1").groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    decided = durable(decided)
    gone, once = (decided.filter(c).select("_id", "_h1", "_h2") for c in ("not kept", "kept and copies > 1"))
    return without(df, id_col, text_col, gone, once)


#: The digest table of op4 in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, points, norm, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
    row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS n
  FROM d
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
