"""Vector code compression: product codes of integer vectors, found by an equal-average search.

A codebook's entries are sorted by the sum of their components. The squared gap between two sums, divided by the
dimension, never exceeds the squared distance; so the search of a part starts between the entries whose sums lie next to its
own, goes outward, and ends when that bound strictly exceeds the best distance. The parts of a batch are searched together,
a step at a time, and leave when their bound is reached.

Vectors never leave their tasks while codebooks are fitted: a task sends sums and counts of entries, PARTS x ENTRIES at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors searched together.
STEP = 4096
#: Components times the length of a part stay below this in size, so that squares of gaps fit into 64 bits.
LARGEST = 1 << 30

#: For each length of vectors: the codebook of each part, entries as rows of integers.
Codebooks = dict[int, list[np.ndarray]]


def edges(length: int) -> list[int]:
    """Where the parts begin and end. Where PARTS doesn't divide the length, parts differ by one component."""
    return [length * i // PARTS for i in range(PARTS + 1)]


def equal_average(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest entry of ``book``, ties to the lower index, and the squared distance."""
    n, dim = x.shape
    if not dim:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(book.sum(axis=1), kind="stable")
    book = book[order]
    far = np.int64(2 * LARGEST)  # wider than any gap: no entry is left on that side
    sums = np.concatenate([book.sum(axis=1), [0]])
    own = x.sum(axis=1)
    rows, up = np.arange(n), np.searchsorted(sums[:-1], own)
    down = up - 1
    best, code = np.full(n, far * far // dim - 1), np.full(n, len(book))
    out_best, out_code = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    while len(rows):
        above = np.where(up < len(book), sums[np.minimum(up, len(book))] - own, far)
        below = np.where(down >= 0, own - sums[np.maximum(down, 0)], far)
        gap = np.minimum(above, below)
        over = gap * gap > best * dim
        if over.any():
            out_best[rows[over]], out_code[rows[over]] = best[over], code[over]
            x, rows, own, up, down, best, code, above, below = (a[~over] for a in (x, rows, own, up, down, best, code, above, below))
        higher = above <= below
        entry = np.where(higher, up, down)
        apart = x - book[entry]
        d, index = np.einsum("ij,ij->i", apart, apart), order[entry]
        better = (d < best) | (d == best) & (index < code)
        best[better], code[better] = d[better], index[better]
        up, down = up + higher, down - ~higher
    return out_code, out_best


def encode(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a column for each part) and total squared distances of integer vectors of one length."""
    at = edges(v.shape[1])
    found = [equal_average(v[:, a:b], book) for a, b, book in zip(at, at[1:], books, strict=False)]
    return np.stack([c for c, _ in found], axis=1), sum(d for _, d in found)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def kept(df: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """``vec_id, v`` and ``more``, of rows whose vector is not null and finite throughout."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *more)
    return rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _measurable() -> Column:
    v = F.col("v")
    return F.forall(v, lambda x: F.abs(F.floor(x * SCALE).cast("double")) * F.greatest(F.size(v), F.lit(PARTS)) < float(LARGEST))


def _integers(lists: pa.ListArray, dim: int) -> np.ndarray:
    return np.floor(np.asarray(lists.flatten()).reshape(len(lists), dim) * SCALE).astype(np.int64)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one length at a time, STEP of them at most."""
    lengths = pc.list_value_length(batch.column(column)).to_numpy()
    for dim in np.unique(lengths).tolist():
        rows = batch.filter(pa.array(lengths == dim))
        for a in range(0, rows.num_rows, STEP):
            yield dim, rows.slice(a, STEP)


def fit(rows: DataFrame) -> Codebooks:
    """Codebooks of ``vec_id, v``: they start as the vectors of the ENTRIES smallest ids and are refined in ROUNDS rounds.

    What reaches the driver has the size of the codebooks. Vectors are read once a round.
    """
    first = Window.partitionBy(F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    start = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= ENTRIES).select(F.size("v").alias("dim"), "n", "v").collect()
    seeds: dict[int, list] = {}
    for r in sorted(start, key=lambda r: (r["dim"], r["n"])):
        seeds.setdefault(r["dim"], []).append(r["v"])
    books: Codebooks = {}
    for dim, vectors in seeds.items():
        v, at = np.floor(np.array(vectors, dtype=float).reshape(len(vectors), dim) * SCALE).astype(np.int64), edges(dim)
        books[dim] = [v[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    for _ in range(ROUNDS):
        books = _refined(rows, books)
    return books


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: [np.zeros_like(b) for b in of] for dim, of in books.items()}
        counts = {dim: [np.zeros(len(b), dtype=np.int64) for b in of] for dim, of in books.items()}
        for batch in batches:
            for dim, part in _by_length(batch, 0):
                v, at = _integers(part.column(0), dim), edges(dim)
                codes, _ = encode(v, books[dim])
                for i in range(PARTS):
                    np.add.at(sums[dim][i], codes[:, i], v[:, at[i] : at[i + 1]])
                    counts[dim][i] += np.bincount(codes[:, i], minlength=len(counts[dim][i]))
        for dim, of in sums.items():
            for i in range(PARTS):
                used = np.flatnonzero(counts[dim][i])
                columns = [pa.array([x] * len(used), pa.int32()) for x in (dim, i)]
                columns += [pa.array(used.astype(np.int32)), pa.array(counts[dim][i][used]), pa.array(list(of[i][used]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "part", "entry", "n", "s"])

    sent = rows.select("v").mapInArrow(summed, "dim int, part int, entry int, n long, s array<long>")
    total = sent.select("dim", "part", "entry", "n", F.posexplode_outer("s").alias("at", "c")).groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = {dim: [b.copy() for b in of] for dim, of in books.items()}
    for r in total.filter("at is not null").collect():
        out[r["dim"]][r["part"]][r["entry"], r["at"]] = r["c"] // r["n"]
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that is not null and finite throughout.

    Components become floor(SCALE * x); each of the PARTS parts of a vector gets the index of its codebook's nearest entry, in
    two hex digits. ``error`` is the sum of the squared distances, ``label_error`` the sum of errors over rows of an equal label
    (nulls are equal). Rows that repeat an id each stay and count; among equal ids the least vector comes first, null ids last.
    With fewer than ENTRIES vectors there are as many entries as vectors; an empty table gives an empty result. Vectors of
    another length have codebooks of their own, an empty vector the code of zeros. A vector of a component so large that
    distances leave 64 bits (LARGEST over its length) takes no part and gets a null code and error. Other columns are ignored.
    """
    every = kept(df, id_col, vector_col, F.col(label_col).alias("label"))
    small = every.filter(_measurable())
    books = fit(small.select("vec_id", "v"))
    digests = {dim: digest(of) for dim, of in books.items()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch, 2):
                codes, errors = encode(_integers(part.column(2), dim), books[dim])
                columns = [pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(errors.astype(np.int64)), pa.array([digests[dim]] * len(codes), pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", every.schema["label"].dataType)])
    schema = schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    out = small.select("vec_id", "label", "v").mapInArrow(coded, schema)
    none = lambda kind: F.lit(None).cast(kind)
    out = durable(out.unionByName(every.filter(~_measurable()).select("vec_id", "label", none("string").alias("code"), none("long").alias("error"), none("string").alias("codebooks_sha256"))))
    of_label = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return out.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    assign = "SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.rid, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{i} b USING (part, pos) GROUP BY ALL) GROUP BY ALL"
    refine = "SELECT b.part, b.entry, b.pos, coalesce(CAST(floor(any_value(m.c)) AS BIGINT), any_value(b.c)) AS c FROM b{i} b LEFT JOIN (SELECT a.part, a.entry, x.pos, sum(x.c)::DOUBLE / count(*) AS c FROM a{i} a JOIN x USING (rid, part) GROUP BY ALL) m USING (part, entry, pos) GROUP BY ALL"
    rounds = "".join(f"a{i} AS MATERIALIZED ({assign.format(i=i)}),\nb{i + 1} AS MATERIALIZED ({refine.format(i=i)}),\n" for i in range(ROUNDS))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda e: CAST(floor({SCALE} * e::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
x AS MATERIALIZED (
  SELECT rid, (pos - 1) * {PARTS} // d AS part, (pos - 1) % (d // {PARTS}) AS pos, c
  FROM (SELECT rid, len(v) AS d, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM k)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, c FROM x WHERE rid <= {ENTRIES}),
{rounds}f AS MATERIALIZED ({assign.format(i=ROUNDS)}),
r AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM f JOIN k USING (rid) GROUP BY rid, vec_id, label),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h
"""


ORACLE = _oracle()
