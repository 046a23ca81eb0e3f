"""MinHash near-duplicates by an inverted join of signature coordinates.

A document is posted under its coordinate-value pairs. Two documents that agree in MATCHES of COORDINATES coordinates share one of
the first COORDINATES - MATCHES + 1 pairs of either, in whatever order all documents keep; so only this prefix is posted, rarest
pairs first, and pairs that one document has are no posting at all. Inside a posting list the collisions of the other coordinates are
counted a few at a time, and what can't reach MATCHES any more is skipped. Sets of shingles decide on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .alike import Group, Search, Wanted, alike_components

SHINGLE = 4
#: Sets alike to 0.8 agree in fewer than MATCHES coordinates once in three million pairs.
COORDINATES = 64
MATCHES = 34
PREFIX = COORDINATES - MATCHES + 1
#: Coordinates counted between looks at which pairs can be skipped, and pairs looked at together.
LOOK = 16
AT_ONCE = 1 << 18
#: Besides its nearest candidate, a set is first compared with the first of those below it that agree in all but so many coordinates.
TIERS = (4, 10)

_RNG = np.random.default_rng(42)
TIMES = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(members: np.ndarray) -> bytes:
    """The least hash of a set for each coordinate: its 32 highest bits, lowest bytes of all coordinates first."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(members), 1 << 12):
        part = members[a : a + (1 << 12)]
        part = part ^ (part >> np.uint64(32))
        for k in range(COORDINATES):
            least[k] = min(least[k], (part * TIMES[k] + PLUS[k]).min())
    return np.ascontiguousarray((least >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(COORDINATES, 4).T).tobytes()


def _postings(reps: DataFrame) -> DataFrame:
    """``key, rep``: the coordinate-value pairs of each set's prefix that another set has too."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                batch = whole.slice(a, 4000)
                planes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 4, COORDINATES)
                value = sum(planes[:, i].astype(np.int64) << 8 * i for i in range(4))
                key = np.arange(COORDINATES, dtype=np.int64) << 32 | value
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES))], names=["key", "rep"])

    every = reps.select("rep", "code").mapInArrow(pairs, "key long, rep long")
    counts = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = every.join(counts, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("of"))
    # pairs that no other set has come first in the prefix
    left = F.greatest(F.lit(0), F.size("of") - (COORDINATES - PREFIX))
    return shared.select(F.explode(F.slice("of", F.lit(1), left)).alias("p"), "rep").select("p.key", "rep")


def _collisions(g: Group, wanted: Wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and the coordinates in which they differ, of pairs of a posting list that agree in MATCHES or more."""
    rows, group, shift = np.arange(len(g.number)), g.number, 1
    while len(rows):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        going = np.repeat(sizes > shift, sizes)  # only lists with a row as many places on go on
        rows, group = rows[going], group[going]
        for a in range(0, len(rows) - shift, AT_ONCE):
            at = np.arange(a, min(a + AT_ONCE, len(rows) - shift))
            at = at[group[at] == group[at + shift]]
            i, j = rows[at], rows[at + shift]
            kept = wanted(i, j)
            i, j = i[kept], j[kept]
            missed = np.zeros(len(i), dtype=np.int64)
            for k in range(0, COORDINATES, LOOK):
                missed += (g.code[i, k : k + LOOK] != g.code[j, k : k + LOOK]).sum(axis=1)
                reach = missed <= COORDINATES - MATCHES
                i, j, missed = i[reach], j[reach], missed[reach]
            if len(i):
                yield i, j, missed
        shift += 1


def search(reps: DataFrame) -> Search:
    """Candidates among ``rep, code``: they share a posting of their prefixes and agree in MATCHES coordinates.

    A row in a posting list carries the lowest byte of each coordinate: bytes of unequal values agree once in 256, which
    adds a few candidates and loses none.
    """
    posted = written(_postings(reps))

    def rows(reps: DataFrame, names: list[str]) -> DataFrame:
        if names == ["rep"]:
            return posted
        more = [F.substring("code", 1, COORDINATES).alias("code") if n == "code" else n for n in names]
        return posted.join(reps.select(*more), "rep").select("key", *names)

    return Search(SHINGLE, signature, COORDINATES, rows, _collisions, TIERS)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    A row's set holds its distinct shingles of four words (at ASCII white space, A-Z lower-cased); fewer words are one
    shingle. Rows link if their sets share 0.8 or more of their union, by the sets themselves; component_id is the smallest id that can be
    reached, and a row stays if that is its own. Null, empty and blank texts have no shingles and link with nothing. Equal
    sets are one node, however many rows have them. Repeated rows each stay, and are kept or not together. A row with a null id has the
    smallest known id of its component, or null, and isn't kept. Of an id that repeats with other texts each text has its own
    component. An empty table gives an empty result; other columns are ignored.
    """
    rows = alike_components(df, id_col, text_col, SHINGLE, signature, search)
    own = rows.filter("n > 0").groupBy("label").agg(F.min("_id").alias("least"))
    found = rows.join(own, "label", "left").select(F.col("_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id")).cast("long").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS shingle
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
r AS (SELECT doc_id AS a, doc_id AS top FROM documents UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.a WHERE r.top < l.b),
c AS (SELECT a, min(top) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
