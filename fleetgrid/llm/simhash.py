"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are held as vertical bit planes: bit b of 64 fingerprints in one word. One pass of word operations
then updates 64 distances, by carry-save counters that overflow above the radius; words of which all 64 distances
have overflowed are abandoned. Candidates share the bits of one of several tables.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import SEED, Group, Search, Wanted, alike_components, apart, components, dealt, dealt_again, edges_to, first_of_each, forest, grouped, shingles
from .common import durable, slices, text_or_empty

#: Planes added between looks at which words can be abandoned, and pairs looked at together.
LOOK = 16
AT_ONCE = 1 << 20


class Scheme(NamedTuple):
    """Words of a shingle, 64-bit words of a fingerprint, bits in which linked ones differ at most, the bits of each table,
    and whether a repeated shingle counts once."""

    shingle: int
    words: int
    radius: int
    tables: tuple[tuple[int, ...], ...]
    distinct: bool = False


def banded(bits: int, radius: int, bands: int) -> tuple[tuple[int, ...], ...]:
    """Tables that lose no link: of the bands, ``radius`` may hold a difference, and any others are a table's bits."""
    edges = [round(bits * i / bands) for i in range(bands + 1)]
    return tuple(tuple(b for i in chosen for b in range(edges[i], edges[i + 1])) for chosen in combinations(range(bands), bands - radius))


def drawn(bits: int, width: int, tables: int) -> tuple[tuple[int, ...], ...]:
    """Tables of randomly drawn bits: two texts meet in one with a chance that falls with the bits they differ in."""
    rng = random.Random(SEED)
    return tuple(tuple(sorted(rng.sample(range(bits), width))) for _ in range(tables))


#: Three words, 64 bits, radius 3: links are exact.
CLOSE = Scheme(3, 1, 3, banded(64, 3, 5))
#: Five words, for candidates of texts whose shingle sets are alike to 0.8 or more. With that likeness (a cosine of 0.89)
#: 15 % of 256 bits differ, 39 with a spread of 5.7; the radius lies three spreads above. That a candidate is alike is
#: decided by the sets themselves.
ALIKE = Scheme(5, 4, 58, drawn(256, 14, 72), True)
#: Besides its nearest candidate, a text is first compared with the first of those below it within each of these distances.
TIERS = (30, 44)


def _wide(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` hashes of each shingle: its own, and others stirred from it."""
    out = [hashes]
    for i in range(1, words):
        h = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(h ^ (h >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(text: str, scheme: Scheme = CLOSE) -> bytes:
    """A bit is 1 if it is set in over half of the hashes of the text's word shingles, repeats included unless distinct."""
    hashes = shingles(text, scheme.shingle)
    return _majority(np.unique(hashes) if scheme.distinct else hashes, scheme.words)


def _majority(hashes: np.ndarray, words: int) -> bytes:
    counts = np.zeros(64 * words, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = _wide(hashes[a : a + (1 << 14)], words).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = CLOSE) -> DataFrame:
    """``doc_id, fp`` of every row; the fingerprint has its highest bit first. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 4_000_000):
                fps = [fingerprint(t, scheme) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, "doc_id long, fp binary")


def _bits(fps: np.ndarray) -> np.ndarray:
    """Rows of bits of an array of fingerprints (rows of bytes)."""
    return np.unpackbits(fps, axis=1)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: a row for each bit, packed 64 fingerprints to a word, one word of zeros behind."""
    bits = np.zeros((-(-len(fps) // 64) * 64 + 64, fps.shape[1] * 8), dtype=np.uint8)
    bits[: len(fps)] = _bits(fps)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(sliced: np.ndarray, words: np.ndarray, shifts: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of 64 fingerprints at a time differ in ``radius`` bits at most from those ``shift`` places on.

    ``words[k]`` names a word of 64 positions and ``alive[k]`` has a bit for each of them that is to be compared; returned
    are k and the bit. All comparisons go on together, plane by plane; words of which all 64 are over are abandoned.
    """
    over, k, by = ~alive, np.arange(len(words)), (shifts % 64).astype(np.uint64)
    low, high = (np.minimum(words + shifts // 64 + x, sliced.shape[1] - 1) for x in (0, 1))
    # counters start so far below their end that the first difference too many overflows
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counters = [np.full(len(words), -(start >> j & 1), dtype=np.int64).view(np.uint64) for j in range(width)]
    for b, row in enumerate(sliced, 1):
        carry = row[words] ^ (row[low] >> by | row[high] << (np.uint64(64) - by))  # a shift by 64 gives 0
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if b % LOOK == 0 and b > radius:
            keep = np.flatnonzero(~over)
            if len(keep) < len(k):
                k, words, low, high, by, over = (x[keep] for x in (k, words, low, high, by, over))
                counters = [c[keep] for c in counters]
            if not len(keep):
                break
    hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(hits)
    return k[at], bit


def _hits(keys: np.ndarray, fps: np.ndarray, radius: int, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by key: positions i < j of links between equal keys, those nearest in place first; ``also`` may rule out pairs."""
    rows, group, first, until = np.arange(len(keys)), keys, 1, 2
    while len(rows):
        # only groups with a row as many places on go on
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(group)])
        going = np.repeat(sizes > first, sizes)
        rows, group = rows[going], group[going]
        if not len(rows):
            break
        sliced, n, most = planes(fps[rows]), len(rows), int(sizes.max())
        step = max(1, AT_ONCE // n)
        for a in range(first, min(until, most), step):
            shifts = np.arange(a, min(a + step, until, most))
            i = np.arange(n)
            j = np.minimum(i + shifts[:, None], n - 1)
            wanted = (group == group[j]) & (i + shifts[:, None] < n)
            if also:
                wanted &= also(rows[None, :], rows[j])
            live = np.zeros((len(shifts), -(-n // 64) * 64), dtype=bool)
            live[:, :n] = wanted
            alive = np.packbits(live, axis=1, bitorder="little").view("<u8")
            at, word = np.nonzero(alive)
            if len(at):
                k, bit = near(sliced, word, shifts[at], alive[at, word], radius)
                if len(k):
                    own = word[k] * 64 + bit
                    yield rows[own], rows[own + shifts[at[k]]]
        first, until = until, until * 4


def _masks(scheme: Scheme) -> np.ndarray:
    """The bits of each table, as words that lie like those of a fingerprint."""
    bits = np.zeros((len(scheme.tables), 64 * scheme.words), dtype=np.uint8)
    for n, table in enumerate(scheme.tables):
        bits[n, list(table)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _met_before(differ: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether pairs, given by the bits in which they differ, share the bits of a table before ``table``: each pair counts once."""
    met = np.zeros(len(differ), dtype=bool)
    for n in range(int(table.max(initial=0))):
        still = np.flatnonzero(~met & (table > n))
        met[still] = ~(differ[still] & masks[n]).any(axis=1)
    return met


def _keyed(reps: DataFrame, names: list[str], scheme: Scheme) -> DataFrame:
    """``key`` and the columns ``names`` of ``reps`` (rep, code, ...): a row for each table."""
    size, columns = 8 * scheme.words, ["rep", "code", *(n for n in names if n not in ("rep", "code"))]
    kinds = ", ".join(f"{c} {reps.schema[c].dataType.simpleString()}" for c in columns)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                bits = _bits(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, size)).astype(np.int64)
                for n, table in enumerate(scheme.tables):
                    key = bits[:, list(table)] @ (1 << np.arange(len(table), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(n << 32 | key), *batch.columns], names=["key", *columns])

    return reps.select(*columns).mapInArrow(keyed, f"key long, {kinds}").select("key", *names)


def _candidates(g: Group, wanted: Wanted, scheme: Scheme, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and the bits in which they differ, of pairs within the radius that no table before has shown."""
    wide, table = np.ascontiguousarray(g.code).view(np.uint64), g.key >> 32
    for i, j in _hits(g.number, g.code, scheme.radius, wanted):
        differ = wide[i] ^ wide[j]
        new = ~_met_before(differ, table[i], masks)
        if new.any():
            yield i[new], j[new], np.bitwise_count(differ[new]).sum(axis=1, dtype=np.int64)


def search(scheme: Scheme) -> Search:
    """Candidates by fingerprints of sets: they share the bits of a table and lie within the radius."""
    return Search(
        scheme.shingle, functools.partial(_majority, words=scheme.words), 8 * scheme.words, functools.partial(_keyed, scheme=scheme), functools.partial(_candidates, scheme=scheme, masks=_masks(scheme)), TIERS
    )


def links(reps: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """Edges ``a, b`` between rows of ``rep, code`` (distinct fingerprints): enough of them to join all that is linked.

    A bucket (rows that share the bits of a table) yields a spanning forest of its links, never its pairs. Where buckets
    were split, what isn't joined yet is compared again.
    """
    size, rows_of = 8 * scheme.words, functools.partial(_keyed, scheme=scheme)

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, size):
            yield edges_to(g.rep, forest(len(g.rep), _hits(g.number, g.code, scheme.radius)))

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, size):
            yield edges_to(g.rep, forest(len(g.rep), _hits(g.number, g.code, scheme.radius, apart(g, g.more[0]))))

    rows, split = dealt(reps, rows_of)
    edges = rows.mapInArrow(linking, "a long, b long").filter("a <> b").distinct()
    if not split:
        return edges
    edges = durable(edges)
    of = components(edges)
    labelled = durable(reps.join(of, reps["rep"] == of["node"], "left").select("rep", "code", F.coalesce("label", "rep").alias("label")))
    return edges.unionByName(dealt_again(labelled, rows_of, "label").mapInArrow(joining, "a long, b long").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = CLOSE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Fingerprints (over word shingles of A-Z lower-cased words, repeats included, by XXH64 with seed 42) link at the
    scheme's radius or less; component_id is the smallest id that can be reached. A text with fewer words
    than a shingle is one shingle; null, empty and blank texts have fingerprint zero and are linked like any other.
    Equal fingerprints are one node, however many rows have them. Repeated rows each stay. Rows with a null id stay
    too: their component is the smallest known id of the component, or null. An empty table gives an empty result.
    """
    prints = durable(fingerprints(df, id_col, text_col, scheme))
    reps = durable(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumnRenamed("fp", "code"))
    # an id repeated with other texts may stand for several fingerprints; then these are one component by the id
    found = components(links(reps, scheme))
    classes = durable(reps.join(found, reps["rep"] == found["node"], "left").select(F.col("code").alias("fp"), F.coalesce("label", "rep").alias("component_id")))
    out = prints.join(classes, "fp", "left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = ALIKE) -> DataFrame:
    """One row of each component of texts whose sets of shingles are alike to 0.8 or more: that with the smallest id, null ids
    last; its columns stay as they are.

    Fingerprints give the candidates and the sets decide (see alike_components). Ids need not tell rows apart; repeated rows are
    alike. Null, empty and blank texts are alike. An empty table gives an empty result.
    """
    found = search(scheme)
    return first_of_each(alike_components(df, id_col, text_col, scheme.shingle, found.code, lambda _: found), df, id_col, text_col)
