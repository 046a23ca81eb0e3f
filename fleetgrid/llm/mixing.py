"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are packed into blocks of fixed length. Every output shard draws how many blocks of each
source it gets; these slots are mapped through a pseudorandom permutation of the source's block indices, one for
each pass over the source, and joined to the blocks by index.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, laid_out, marks

#: Words in a block; least slots in an output shard; the mix's words as a share of all words (3/2); times a source may be used.
BLOCK = 512
SHARD_SLOTS = 1024
SHARE = (3, 2)
TIMES = 2
#: Slots that a task lists and permutes, about.
TASK_SLOTS = 1 << 14
#: Times its share of the rows from which a bucket of a source is divided.
CROWDED = 8
WEIGHTS = (5, 2, 1)
CHUNK = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """``source, ord, source_size, target`` for each row of ``source, source_size``.

    Sources in code point order, null last, weigh WEIGHTS in turn and share SHARE of all words. A target stops at
    TIMES its source's size; what is above is reshared by weight among the others until none is above. That end state
    is a water level: sources in order of cap per weight are capped as long as the level reached without them exceeds
    their own ratio.
    """
    everything, up = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    num, den = SHARE
    out = sizes.withColumn("ord", F.row_number().over(up) - 1).withColumn("w", F.element_at(F.lit(list(WEIGHTS)), (F.col("ord") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    out = out.withColumn("pool", num * F.sum("source_size").over(everything)).withColumn("cap", TIMES * F.col("source_size"))
    # ratios are compared as whole numbers by way of a common multiple of the weights
    by_ratio = Window.orderBy(F.expr(f"cap * {WEIGHTS[0] * WEIGHTS[1] * WEIGHTS[2]} div w"), "ord")
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("capped", (F.col("pool") - den * F.col("before")) * F.col("w") > den * F.col("cap") * F.col("rest"))
    out = out.withColumn("used", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
    out = out.withColumn("open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything))
    share = (F.col("w") * (F.col("pool") - den * F.col("used"))).cast("double") / (den * F.col("open")).cast("double")
    return out.select("source", "ord", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _hash32(text: str) -> Column:
    return F.expr(f"cast(conv(substr(md5({text}), 1, 8), 16, 10) as bigint)")


def _stirred(x: str, key: str) -> str:
    return f"((({x} + {key}) % 65521) * (({x} + {key}) % 65521) % 1000003 * (({x} + {key}) % 65521 + 12345) % 999983)"


def _pass(x: str, key: str, turn: int) -> str:
    """One pass over x: four rounds in which the halves of a pair swap, the one shifted by a hash of the other."""
    keys = ", ".join(f"{key} + {101 + 2 * r + turn}" for r in range(4))
    merge = f"(s, k) -> named_struct('l', s.r, 'r', (s.l + {_stirred('s.r', 'k')}) % s.m, 'm', s.n, 'n', s.m)"
    pairs = f"aggregate(array({keys}), named_struct('l', p div _b, 'r', p % _b, 'm', _a, 'n', _b), {merge}, s -> s.l * _b + s.r)"
    return f"element_at(transform(array({x}), p -> if(p < _a * _b, {pairs}, p)), 1)"


def permuted(df: DataFrame, at: str, n: str, key: str, out: str) -> DataFrame:
    """``out``: the image of ``at`` under a permutation of 0 to n-1 that the key picks.

    The numbers below a*b, with a and b near the root of n, are pairs whose halves are shifted by a hash of each other
    in turn; a shift by n/2 and a second pass move the few numbers above a*b as well. Each step can be undone.
    """
    df = df.withColumn("_a", F.expr(f"greatest(cast(floor(sqrt({n})) as bigint), 1L)")).withColumn("_b", F.expr(f"greatest({n} div _a, 1L)"))
    return df.withColumn(out, F.expr(_pass(f"({_pass(at, key, 0)} + {n} div 2) % greatest({n}, 1L)", key, 1))).drop("_a", "_b")


class Mix:
    """The parts of a mix: ``documents`` (rows with their place in the word stream of their source) and ``segments``
    (the words of a document that a slot of an output shard takes). With ``marked``, documents have the marks of their text."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, marked: bool = False):
        self.own = [*marks(text_col)] if marked else []
        sized = durable(
            df.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in marks(text_col).items()), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        )
        counts = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
        self.sources = durable(targets(counts))
        self.documents = durable(self._placed(sized))
        self.segments = self._segments(block)

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Where each row starts in its source, by two running sums: over buckets of a source, and inside a bucket.

        There are about as many buckets as rows in a bucket, so neither sum meets more than about the root of the rows: rows that are
        equal throughout are counted first, and a bucket with CROWDED times its share, as of rows with a null or repeated id, is
        divided by the text.
        """
        counted = durable(sized.groupBy("doc_id", "_h1", "_h2", "source", "size").agg(F.count("*").alias("copies")))
        n = counted.count()
        buckets = isqrt(max(n - 1, 0)) + 1
        rows = counted.join(self.sources.select("source", "ord"), counted["source"].eqNullSafe(self.sources["source"])).drop("source")
        rows = rows.withColumn("bucket", _hash32("coalesce(cast(doc_id as string), '')") % buckets)
        crowded = durable(rows.groupBy("ord", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED * buckets).select("ord", "bucket", F.expr(f"n div {buckets}").alias("parts")))
        rows = rows.join(F.broadcast(crowded), ["ord", "bucket"], "left").withColumn("part", F.coalesce(F.pmod("_h1", "parts"), F.lit(0))).drop("parts")
        own = ["ord", "bucket", "part"]
        sums = rows.groupBy(*own).agg(F.expr("sum(size * copies)").alias("words"))
        sums = durable(sums.withColumn("base", F.sum("words").over(Window.partitionBy("ord").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).drop("words"))
        inside = Window.partitionBy(*own).orderBy("doc_id", "size", "_h1", "_h2").rowsBetween(Window.unboundedPreceding, 0)
        words = F.col("size") * F.col("copies")
        placed = rows.withColumn("inside", F.sum(words).over(inside) - words).join(sums, own)
        placed = laid_out(placed.select("doc_id", "_h1", "_h2", "ord", "size", "copies", (F.col("base") + F.col("inside")).alias("start")), "copies", "nth")
        return placed.select("doc_id", *self.own, "ord", "size", (F.col("start") + F.col("nth") * F.col("size")).alias("start"))

    def _slots(self, block: int) -> DataFrame:
        """``ord, slot, shard, block_index, words``: each slot of the mix, and how many words of its block it takes.

        A slot's shard is drawn evenly by a hash, so a shard's counts by source are multinomial draws, conditioned on
        the total of each source: targets are met to the word, and no source is used more than TIMES.
        """
        quota = self.sources.select(
            "ord", F.col("source_size").alias("words"), F.expr("cast(round(target) as bigint)").alias("quota"), F.expr(f"source_size div {block}").alias("whole"), F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks")
        ).filter("quota > 0")
        quota = quota.withColumn("rounds", F.expr("quota div words")).withColumn("rest", F.expr("quota % words"))
        quota = durable(quota.withColumn("slots", F.expr(f"rounds * blocks + (rest + {block - 1}) div {block}")))
        n = quota.agg(F.sum("slots")).first()[0] or 0
        shards = max(1, ceil(n / max(SHARD_SLOTS, isqrt(n))))

        chunks = quota.select("ord", "slots", F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK}L)")).alias("chunk")).repartition("ord", "chunk")
        drawn = chunks.select("ord", F.explode(F.expr(f"sequence(chunk, least(chunk + {CHUNK}, slots) - 1)")).alias("slot"))
        drawn = drawn.groupBy("ord", (_hash32("concat(ord, ':', slot)") % shards).alias("shard")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("ord").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
        counts = durable(drawn.withColumn("first", upto - F.col("n")))
        # counts are few bytes, which adaptive execution would leave to one task; what comes of them is many rows
        dealt = counts.join(quota, "ord").repartition(ceil(n / TASK_SLOTS) + 1, "ord", "shard")
        slots = dealt.withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
        slots = slots.withColumns({"round": F.expr("slot div blocks"), "at": F.expr("slot % blocks")})
        slots = permuted(slots, "least(at, greatest(whole - 1, 0))", "whole", "(ord * 7919 + round * 104729 + 17)", "image")
        return slots.select(
            "ord",
            "shard",
            "slot",
            F.expr("if(at < whole, image, whole)").alias("block_index"),
            F.expr(f"if(round < rounds, {block}L, least({block}L, rest - at * {block}))").alias("words"),
        )

    def _segments(self, block: int) -> DataFrame:
        """``ord, start, shard, slot, first_word, n_words``: start tells the document, first_word counts inside it."""
        pieces = self.documents.filter("size > 0").select("ord", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block_index"))
        pieces = pieces.withColumn("low", F.expr(f"greatest(start - block_index * {block}, 0)")).withColumn("high", F.expr(f"least(start + size - block_index * {block}, {block}L)"))
        # what Spark expects of the slots comes from the few rows that they are listed from, so it would broadcast them
        joined = pieces.join(self._slots(block).hint("merge"), ["ord", "block_index"]).withColumn("n_words", F.expr("least(high, words) - low"))
        return joined.filter("n_words > 0").select("ord", "start", "shard", "slot", F.expr(f"block_index * {block} + low - start").alias("first_word"), "n_words")

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every row."""
        words = self.segments.groupBy("ord", "start").agg(F.sum("n_words").alias("taken"))
        # rows without words share their start with the next row, and take nothing
        some = self.documents.filter("size > 0").join(words, ["ord", "start"], "left").select("doc_id", "ord", "size", "taken")
        none = self.documents.filter("size = 0").select("doc_id", "ord", "size", F.lit(None).cast("long").alias("taken"))
        return some.unionByName(none).join(self.sources, "ord").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """What the mix takes of every row. Null texts have no words; a null source is a source of its own, the last one;
    null ids and repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
    Reruns agree, whatever the partitions: every draw is a hash of ids and indices."""
    return Mix(df, id_col, text_col, source_col, block).taken()


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as rows with the columns of ``df``: one row for each pass in which it takes words of a document.

    A pass that takes all words keeps the text as it is. One that takes some of its blocks keeps those words, in
    order, with the white space before each; ``n_chars``, if there is such a column, follows the text.
    A row is found again by its id, text and source together; rows that share all three are numbered, so that each gets
    the spans of one place.
    """
    m = Mix(df, id_col, text_col, source_col, block, marked=True)
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    spans = m.segments.join(m.sources.select("ord", blocks.alias("blocks")), "ord").withColumn("round", F.expr("slot div blocks"))
    spans = spans.groupBy("ord", "start", "round").agg(F.sum("n_words").alias("_taken"), F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans"))
    places = m.documents.filter("size > 0").join(m.sources.select("ord", "source"), "ord")
    places = places.select(F.struct(F.col("doc_id").alias("id"), *m.own, "source").alias("_key"), "ord", "start", "size")
    # only the few documents that a pass cuts keep their list of spans
    spans = durable(spans.join(places, ["ord", "start"]).select("_key", "ord", "start", F.when(F.col("_taken") < F.col("size"), F.col("_spans")).alias("_spans")))
    rows = df.withColumn("_key", F.struct(F.col(id_col).alias("id"), *(c.alias(k) for k, c in marks(text_col).items()), F.col(source_col).cast("string").alias("source")))
    repeated = durable(places.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select("_key"))
    if repeated.isEmpty():
        out = rows.join(spans.select("_key", "_spans"), "_key")
    else:
        out = rows.join(repeated, "_key", "left_anti").join(spans.select("_key", "_spans"), "_key")
        again = durable(rows.join(repeated, "_key", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
        nth = lambda *by: F.row_number().over(Window.partitionBy("_key").orderBy(*by)).alias("_nth")
        owner = again.select("_key", "_row", nth("_row")).join(places.join(repeated, "_key", "left_semi").select("_key", "ord", "start", nth("start")), ["_key", "_nth"])
        given = durable(owner.join(spans.drop("_key"), ["ord", "start"]).select("_row", "_spans"))
        out = out.unionByName(again.join(given, "_row").select(*out.columns))
    words = F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    kept = F.transform("_spans", lambda s: F.slice(words, (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")))
    cut = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(kept), ""))
    # the one-row explode keeps the lambda from being copied into a second column, where Spark 4.1 mixes up its variable
    out = out.select(*(F.col(c) for c in df.columns if c != text_col), F.explode(F.array(cut)).alias(text_col))
    columns = [F.length(text_col).cast(df.schema[c].dataType).alias(c) if c == "n_chars" else c for c in df.columns]
    return out.select(*columns)


def _oracle() -> str:
    stir = lambda x, k: f"((({x} + {k}) % 65521) * (({x} + {k}) % 65521) % 1000003 * (({x} + {k}) % 65521 + 12345) % 999983)"
    steps, at = [], "perm0"
    for turn in (0, 1):
        names = [f"q{turn}{i}" for i in range(5)]
        steps.append(f"{names[0]} AS (SELECT *, p // b AS l, p % b AS r FROM {at})")
        for i in range(4):
            shifted = stir("r", f"(ord * 7919 + round * 104729 + 17) + {101 + 2 * i + turn}")
            steps.append(f"{names[i + 1]} AS (SELECT * REPLACE (r AS l, (l + {shifted}) % {'ab'[i % 2]} AS r) FROM {names[i]})")
        back = "CASE WHEN p < a * b THEN l * b + r ELSE p END"
        steps.append(f"perm{turn + 1} AS (SELECT * EXCLUDE (p, l, r), {back if turn else f'({back} + whole // 2) % greatest(whole, 1)'} AS p FROM {names[4]})")
        at = f"perm{turn + 1}"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord, 2 * source_size AS cap FROM s0
), s2 AS (SELECT *, [5, 2, 1][ord % 3 + 1]::BIGINT AS w FROM s1
), level AS (
  -- resharing: cap what is above, share the rest by weight, until none is above
  SELECT 0 AS k, (SELECT list(NULL::BIGINT ORDER BY ord) FROM s2) AS done
  UNION ALL
  SELECT k + 1, (
    SELECT list(CASE WHEN done[ord + 1] IS NOT NULL THEN done[ord + 1] WHEN w * (3 * t - 2 * used) > 2 * cap * open THEN cap END ORDER BY ord)
    FROM s2, (SELECT sum(source_size)::BIGINT AS t, coalesce(sum(done[ord + 1]), 0)::BIGINT AS used, sum(w) FILTER (done[ord + 1] IS NULL)::BIGINT AS open FROM s2))
  FROM level WHERE k < (SELECT count(*) FROM s2)
), final AS (SELECT done FROM level ORDER BY k DESC LIMIT 1
), src AS MATERIALIZED (
  SELECT source, ord, source_size, coalesce(done[ord + 1]::DOUBLE, (w * (3 * t - 2 * used))::DOUBLE / (2 * open)::DOUBLE) AS target
  FROM s2, final, (SELECT sum(source_size)::BIGINT AS t, coalesce(sum(done[ord + 1]), 0)::BIGINT AS used, sum(w) FILTER (done[ord + 1] IS NULL)::BIGINT AS open FROM s2, final)
), p AS MATERIALIZED (
  SELECT doc_id, ord, size, sum(size) OVER (PARTITION BY ord ORDER BY ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 8))::BIGINT % (SELECT ceil(sqrt(count(*)))::BIGINT FROM d), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), q0 AS (SELECT ord, source_size AS words, round(target)::BIGINT AS quota, source_size // {BLOCK} AS whole, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM src WHERE round(target) > 0
), q1 AS (SELECT *, quota // words AS rounds, quota % words AS rest FROM q0
), sl AS (SELECT *, unnest(range(rounds * blocks + (rest + {BLOCK - 1}) // {BLOCK}))::BIGINT AS slot FROM q1
), sr AS (SELECT *, slot // blocks AS round, slot % blocks AS pos FROM sl
), perm0 AS (SELECT *, greatest(floor(sqrt(whole))::BIGINT, 1) AS a, greatest(whole // greatest(floor(sqrt(whole))::BIGINT, 1), 1) AS b, least(pos, greatest(whole - 1, 0)) AS p FROM sr
), {", ".join(steps)}
, fin AS (SELECT ord, CASE WHEN pos < whole THEN p ELSE whole END AS bi, CASE WHEN round < rounds THEN {BLOCK} ELSE least({BLOCK}, rest - pos * {BLOCK}) END AS n FROM perm2
), got AS (
  SELECT p.ord, p.start, sum(greatest(0, least(p.start + p.size, bi * {BLOCK} + n) - greatest(p.start, bi * {BLOCK})))::BIGINT AS taken
  FROM p JOIN fin ON fin.ord = p.ord AND bi BETWEEN p.start // {BLOCK} AND (p.start + p.size - 1) // {BLOCK} WHERE p.size > 0 GROUP BY ALL
)
SELECT p.doc_id, p.size, source_size, target, CASE WHEN p.size = 0 THEN 0 ELSE coalesce(taken, 0) END AS taken FROM p JOIN src USING (ord) LEFT JOIN got ON got.ord = p.ord AND got.start = p.start
"""


ORACLE = _oracle()
