"""Sharding by sampled splitters, with DataFrame functions only.

Size-weighted samples of the record keys give quantile boundaries; records are range-partitioned by them, ranges
that turn out overfull are subdivided by key, keys that are overfull by themselves by row, and runs of what comes of it with near
equal bytes become the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, laid_out, text_or_empty

SHARDS = 16
#: Ranges per shard, and expected samples per range. Splitters are SHARDS x RANGES at most, whatever the input's size.
RANGES = 64
SAMPLES = 16


def _hash52(text: str) -> F.Column:
    """A hash of 52 bits as a long."""
    return F.expr(f"cast(conv(substr(md5({text}), 1, 13), 16, 10) as bigint)")


def splitters(rows: DataFrame, total: int, ranges: int, samples: int) -> list[int]:
    """Upper boundaries of the ranges by key, from a size-weighted sample of ``ranges * samples`` expected rows.

    A row is drawn with a chance in proportion to its size, that of its copies included; rows larger than one sampling step are
    always drawn and weigh their size. At most ``ranges`` numbers come to the driver.
    """
    step = max(1, total // (ranges * samples))
    drawn = rows.filter(F.expr(f"draw % {step} < size * copies")).select("key", "doc_id", F.greatest(F.expr("size * copies"), F.lit(step)).alias("weight"))
    running = Window.orderBy("key", "doc_id", "weight").rowsBetween(Window.unboundedPreceding, 0)
    ranked = drawn.withColumn("upto", F.sum("weight").over(running)).withColumn("all", F.sum("weight").over(Window.partitionBy()))
    quantiles = ranked.withColumn("q", F.expr(f"(2 * upto - weight) * {ranges} div (2 * all)")).groupBy("q").agg(F.max("key").alias("key"))
    return sorted(r["key"] for r in quantiles.select("key").distinct().collect())


def _range_of(bounds: list[int]) -> F.Column:
    """The number of boundaries below the key: first among every n-th boundary, then among the n of that part."""
    n = max(1, round(len(bounds) ** 0.5))
    literal = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})" if xs else "cast(array() as array<bigint>)"
    part = f"size(filter({literal(bounds[n - 1 :: n])}, b -> b < key)) * {n}"
    return F.expr(f"{part} + size(filter(slice({literal(bounds)}, {part} + 1, {n}), b -> b < key))")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; the law is ``bytes``.

    The key is a hash of the text, so equal texts follow each other and share a shard, unless they alone have over twice
    a range's share of the bytes or of the rows: the rows of such a key are dealt out one by one. Any other range that has as
    much is subdivided between keys. Units (ranges and their parts) are laid end to end in key order, and a unit goes to
    the shard in which its middle byte lies: each shard's bytes differ from an even share by one unit at most. Slots count
    the rows of a shard from 0 without gaps. Null texts count as empty (one byte, checksum 0); ids may be null or repeat, and rows
    that are equal throughout are counted before they are dealt out; each gets a slot. An empty table gives an empty result; other
    columns are ignored. Reruns agree.
    """
    counted = durable(
        df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
        .select(
            "doc_id",
            (F.octet_length("_text") + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.col("_text").cast("binary")).alias("text_crc32"),
            _hash52("_text").alias("key"),
            _hash52("coalesce(cast(doc_id as string), '')").alias("draw"),
        )
        .groupBy("doc_id", "size", "text_crc32", "key", "draw")
        .agg(F.count("*").alias("copies"))
    )
    whole = counted.agg(F.coalesce(F.expr("sum(size * copies)"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    total, n_rows, n_ranges = whole["bytes"], whole["rows"], shards * ranges
    placed = counted.withColumn("range", _range_of(splitters(counted, total, n_ranges, samples)))
    shares = F.expr(f"greatest((bytes * {n_ranges} + {total} - 1) div {max(total, 1)}, (rows * {n_ranges} + {n_rows} - 1) div {max(n_rows, 1)})").alias("parts")
    fill = [F.expr("sum(size * copies)").alias("bytes"), F.sum("copies").alias("rows")]

    # all tables that are broadcast have a bound: each of their rows has over twice a range's share of the bytes or rows, or is
    # a part of about a share
    overfull = durable(placed.groupBy("range").agg(*fill).select("range", shares).filter("parts > 2"))
    inside = placed.join(F.broadcast(overfull.select("range")), "range")
    hot = durable(inside.groupBy("key").agg(*fill).select("key", shares).filter("parts > 2").withColumnRenamed("parts", "key_parts"))
    rows = laid_out(placed, "copies", "nth").join(F.broadcast(overfull), "range", "left").join(F.broadcast(hot), "key", "left")
    of_key = F.col("key_parts").isNotNull()
    units_of = rows.withColumn("hot", F.when(of_key, F.col("key")).otherwise(F.lit(-1).cast("long")))
    units_of = units_of.withColumn("part", F.when(of_key, F.expr("(draw + nth) % key_parts")).otherwise(F.expr("coalesce(key % parts, 0)"))).drop("parts", "key_parts", "draw")

    unit = ["range", "hot", "part"]
    units = units_of.groupBy(*unit).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    along = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("upto", F.sum("bytes").over(along)).withColumn("shard", F.expr(f"cast(least((2 * upto - bytes) * {shards} div {max(2 * total, 1)}, {shards - 1}) as int)"))
    before = Window.partitionBy("shard").orderBy(*unit).rowsBetween(Window.unboundedPreceding, 0)
    units = durable(units.withColumn("first_slot", F.sum("rows").over(before) - F.col("rows")).select(*unit, "shard", "first_slot"))

    own = Window.partitionBy(*unit).orderBy("key", "doc_id", "size", "text_crc32", "nth")
    numbered = units_of.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(units), unit).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: op10 in DuckDB. The checksum is folded over the bytes; its table has one entry for each byte.
ORACLE = r"""
WITH t AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), h AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS txt, hex(encode(coalesce(text, ''))) AS hx FROM documents
), n AS MATERIALIZED (
  SELECT doc_id, (length(hx) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hx, '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c // 256, tab[(xor(c % 256, b) + 1)::BIGINT])), 4294967295::BIGINT) AS text_crc32,
    ('0x' || left(md5(txt), 13))::BIGINT AS key, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 13))::BIGINT AS draw
  FROM h, t
), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key, doc_id, size, text_crc32) - 1 AS nth FROM n
), d AS (SELECT doc_id, size, key, draw, count(*) AS copies FROM n GROUP BY doc_id, size, text_crc32, key, draw
), a AS (SELECT sum(size)::BIGINT AS total, count(*) AS n_rows, greatest(1, sum(size)::BIGINT // 16384) AS step FROM n
), s AS (SELECT key, doc_id, greatest(size * copies, step) AS weight FROM d, a WHERE draw % step < size * copies
), r AS (SELECT key, weight, sum(weight) OVER (ORDER BY key, doc_id, weight ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(weight) OVER ()::BIGINT AS w FROM s
), b AS (SELECT list(DISTINCT key) AS bounds FROM (SELECT max(key) AS key FROM r GROUP BY (2 * upto - weight) * 1024 // (2 * w))
), p AS MATERIALIZED (SELECT o.*, len(list_filter(bounds, lambda x: x < key)) AS rng FROM o, b
), f AS (
  SELECT rng, greatest((sum(size)::BIGINT * 1024 + any_value(total) - 1) // any_value(total), (count(*) * 1024 + any_value(n_rows) - 1) // any_value(n_rows)) AS parts
  FROM p, a GROUP BY rng
), q AS (
  SELECT key, greatest((sum(size)::BIGINT * 1024 + any_value(total) - 1) // any_value(total), (count(*) * 1024 + any_value(n_rows) - 1) // any_value(n_rows)) AS key_parts
  FROM p, a GROUP BY key
), u AS MATERIALIZED (
  SELECT p.*, CASE WHEN key_parts > 2 THEN key ELSE -1 END AS hot, CASE WHEN key_parts > 2 THEN (draw + nth) % key_parts WHEN parts > 2 THEN key % parts ELSE 0 END AS part FROM p JOIN f USING (rng) JOIN q USING (key)
), g AS (SELECT rng, hot, part, sum(size)::BIGINT AS bytes, count(*) AS n FROM u GROUP BY ALL
), c AS (SELECT *, sum(bytes) OVER (ORDER BY rng, hot, part ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM g
), e AS (SELECT rng, hot, part, n, least((2 * upto - bytes) * 16 // (2 * total), 15)::INT AS shard FROM c, a
), k AS (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY rng, hot, part ROWS UNBOUNDED PRECEDING)::BIGINT - n AS first_slot FROM e)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, first_slot + row_number() OVER (PARTITION BY rng, hot, part ORDER BY key, doc_id NULLS FIRST, size, text_crc32, nth) - 1 AS slot, NULL::INT AS grown_shard
FROM u JOIN k USING (rng, hot, part)
"""
