"""Approximate nearest neighbours by additive quantisation.

A vector is stored as the sum of one full-dimensional codeword from each codebook, found by beam search over the
residuals. Queries score the codes by lookup tables of inner products; the best of each block are scored again
exactly, in double precision, on the vectors themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Codebooks and codewords in each; beam width; vectors that codebooks are fitted on (at most) and rounds of fitting.
BOOKS, WORDS, BEAM = 12, 256, 4
FIT_ROWS, FIT_ROUNDS = 8192, 6
#: Neighbours; share of a block that is scored again exactly, and the least number.
NEIGHBOURS, RERANK_SHARE, RERANK_LEAST = 20, 0.06, 200
#: Vectors in a block, queries in a block, and queries that a task scores at once.
BLOCK_ROWS, QUERY_ROWS, STEP = 4096, 2048, 32


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1) - 2 * x @ words.T, axis=1)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Codebooks (books, words, dimension): each is a k-means of what the ones before leave over."""
    rng = np.random.default_rng(0)
    left, out = sample.astype(np.float32), []
    for _ in range(books):
        centres = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            own = _nearest(left, centres)
            count = np.bincount(own, minlength=words)
            order = np.argsort(own, kind="stable")
            starts = np.searchsorted(own[order], np.flatnonzero(count))
            centres[count > 0] = np.add.reduceat(left[order], starts, axis=0) / count[count > 0, None]
        out.append(centres)
        left = left - centres[_nearest(left, centres)]
    return np.stack(out)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) and the squared norms of the sums that they stand for, keeping ``beam`` partial sums a row."""
    x = x.astype(np.float32)
    n, codes = len(x), np.zeros((len(x), 1, 0), dtype=np.uint8)
    left = x[:, None, :]
    for words in codebooks:
        # |left - word|^2 without |left|^2 of the row itself: partial sums of a row differ in it, so it is added
        far = (left * left).sum(2)[:, :, None] + (words * words).sum(1) - 2 * left @ words.T
        flat = far.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        from_, word = np.divmod(best, len(words))
        codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        left = np.take_along_axis(left, from_[:, :, None], axis=1) - words[word]
    best = (left * left).sum(2).argmin(axis=1)
    rows = np.arange(n)
    total = x - left[rows, best]
    return codes[rows, best], (total * total).sum(1)


def candidates(queries: np.ndarray, codes: np.ndarray, codebooks: np.ndarray, n: int, norms: np.ndarray | None = None) -> np.ndarray:
    """For each query, positions of the ``n`` codes with the largest inner product by lookup tables, or with ``norms``
    the least distance."""
    tables = np.einsum("qd,bwd->bqw", queries.astype(np.float32), codebooks, optimize=True)
    scores = np.zeros((len(queries), len(codes)), dtype=np.float32)
    for book, table in enumerate(tables):
        scores += np.take(table, codes[:, book], axis=1)
    if norms is not None:
        scores -= norms / 2
    if n >= len(codes):
        return np.broadcast_to(np.arange(len(codes)), scores.shape)
    return np.argpartition(scores, len(codes) - n, axis=1)[:, len(codes) - n :]


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of each query (q, d) with its own vectors (q, n, d), added up in the order of the dimensions."""
    out = np.zeros(vectors.shape[:2])
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[:, :, d]
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: vectors that are finite throughout and not zero."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0").filter(fine)


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, squared: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``df`` found for each query, but never its own row.

    Nearness is the inner product, or with ``squared`` the squared distance taken negative, for which the index stores the
    norms of the coded sums; scores are exact, ties go to the smaller id. ``queries`` has ``vec_id`` and ``v``. Equal
    vectors are one entry of the index with the k+1 smallest ids that have it, as no answer needs more. Vectors that are
    null, zero, or hold null or non-finite components take no part; vectors of each length are searched among those of
    that length, in an index of their own (lengths are few: each is a search); with fewer candidates than k
    all are returned; empty tables give an empty result; rows that repeat an id and its vector count once.

    The index holds every vector, in blocks of BLOCK_ROWS at most. A task holds one block and one block of queries;
    it scores all codes of the block by lookup and RERANK_SHARE of them exactly, and passes on k rows a query. The
    codebooks are fitted on FIT_ROWS vectors at most, picked by a hash.
    """
    rows = usable(df, id_col, vector_col)
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    asked = {r["n"] for r in queries.select(F.size("v").alias("n")).distinct().collect()}
    found = [_search(*(of.filter(F.size("v") == n) for of in (rows, queries)), k, squared) for n in lengths if n in asked]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, queries: DataFrame, k: int, squared: bool) -> DataFrame:
    """See search; rows and queries are ``vec_id, v`` of one length."""
    same = Window.partitionBy("v").orderBy("vec_id")
    first_ids = rows.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    entries = durable(first_ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    # a hash picks a few more rows than wanted before they are ordered, so partitions don't each send FIT_ROWS
    spare = FIT_ROWS + 6 * isqrt(FIT_ROWS)
    drawn = entries.filter(F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 40)) < (spare << 40) // n) if n > spare else entries
    sample = np.array([r["v"] for r in drawn.orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).collect()])
    codebooks = fit(sample)
    dim = sample.shape[1]
    blocks = max(1, -(-n // (BLOCK_ROWS * 3 // 4)))
    n_queries = queries.count()
    query_blocks = max(1, -(-n_queries // QUERY_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, ids, v), sorted by block, as one row a block: ids, their ends, vectors, codes."""
        held: list[pa.RecordBatch] = []

        def packed(part: pa.Table) -> pa.RecordBatch:
            x = np.asarray(pa.concat_arrays(part["v"].chunks).flatten()).reshape(-1, dim)
            ids = pa.concat_arrays(part["ids"].chunks)
            codes, norms = (np.concatenate(c) for c in zip(*(encode(x[a : a + 1024], codebooks) for a in range(0, len(x), 1024)), strict=True))
            ends = np.cumsum(pc.list_value_length(ids).to_numpy()).astype(np.int64)
            cells = [c.tobytes() for c in (np.asarray(ids.flatten()).astype(np.int64), ends, x, codes, norms.astype(np.float32))]
            return pa.RecordBatch.from_arrays([pa.array([part["block"][0].as_py()], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["block", "ids", "ends", "x", "codes", "norms"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            block = np.asarray(whole["block"])
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts[: None if last else -2], cuts[1 : None if last else -1], strict=False):
                if a < b:
                    yield packed(whole.slice(a, b - a))
            held[:] = [] if last else whole.slice(cuts[-2]).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            yield from flush(False)
        if held:
            yield from flush(True)

    blocked = entries.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), "ids", "v").repartition(blocks, "block").sortWithinPartitions("block", "v")
    index = durable(blocked.mapInArrow(pack, "block int, ids binary, ends binary, x binary, codes binary, norms binary"))
    asked = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("part"))
    asked = asked.groupBy("part").agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = asked.join(index, "block").repartition(blocks * query_blocks, "block", "part")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column(0)[i].values
                q_ids = np.asarray(q.field(0))
                asked_v = np.asarray(q.field(1).flatten()).reshape(-1, dim)
                ids, ends, x, codes, norms = (np.frombuffer(batch.column(j)[i].as_py(), dtype=t) for j, t in ((1, "i8"), (2, "i8"), (3, "f8"), (4, "u1"), (5, "f4")))
                x, codes = x.reshape(-1, dim), codes.reshape(-1, len(codebooks))
                starts, many = np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])
                again = min(len(x), max(RERANK_LEAST, int(len(x) * RERANK_SHARE)))
                for a in range(0, len(q_ids), STEP):
                    own, v = q_ids[a : a + STEP], asked_v[a : a + STEP]
                    picked = candidates(v, codes, codebooks, again, norms if squared else None)
                    score = exact(v, x[picked])
                    if squared:
                        score = 2 * score - exact(v, np.broadcast_to(v[:, None], (*picked.shape, dim))) - (x * x).sum(1)[picked]
                    keep = min(k + 1, again)  # the query's own vector may be one of them, with no other id
                    floor = np.partition(score, again - keep, axis=1)[:, again - keep]
                    row, at = np.nonzero(score >= floor[:, None])
                    entry, s = picked[row, at], score[row, at]
                    reps = np.repeat(np.arange(len(row)), many[entry])
                    within = np.arange(len(reps)) - np.repeat(np.cumsum(many[entry]) - many[entry], many[entry])
                    row, found, s = row[reps], ids[starts[entry[reps]] + within], s[reps]
                    other = found != own[row]
                    row, found, s = row[other], found[other], s[other]
                    order = np.lexsort((found, -s, row))
                    row, found, s = row[order], found[order], s[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    top = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(own[row[top]]), pa.array(found[top]), pa.array(s[top])], names=["query_id", "vec_id", "score"])

    found = paired.select("q", "ids", "ends", "x", "codes", "norms").mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(df: DataFrame, every: int = 20) -> DataFrame:
    """The neighbours of the rows of an embeddings table whose id is divisible by ``every``, among all its rows.

    Rows with a null id ask nothing, and aren't found. Of an id that repeats with other vectors the least vector asks, and
    each of them can be found. Other columns are ignored; an empty table gives an empty result.
    """
    queries = usable(df, "vec_id", "embedding").filter(F.col("vec_id") % every == 0)
    return search(df, queries.groupBy("vec_id").agg(F.min("v").alias("v")))
