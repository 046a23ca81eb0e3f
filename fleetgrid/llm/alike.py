"""Texts whose sets of word shingles are alike, joined into components around any search for candidates.

A search deals coded sets out to buckets in which candidates meet. First each set is compared with a few of its candidates,
which joins most of what is alike. Candidates that are still apart then form clusters: buckets send a forest of them, never
the pairs, and each set goes once to its cluster, where the sets themselves are compared. So a pair that is not alike leaves no task,
however long its texts, and a large group of near copies never yields its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .common import durable, marks, slices, text_or_empty, without

SEED = 42
#: Sets compared in one group; larger buckets and clusters are dealt out in parts of this size.
PART = 1024
#: Members of the sets in a part of a cluster: 32 MB of hashes.
MEMBERS = 1 << 22
#: Sets are alike if they share this part of their union, in hundredths.
PERCENT = 80
#: Bits of the sketch that goes to buckets: each tells whether an odd number of members falls on it.
SKETCH_BITS = 512

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]
#: Whether pairs of rows (i, j) are to be compared.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Group(NamedTuple):
    """Whole groups of dealt rows, sorted by group: its number and key, the third column, and the others."""

    number: np.ndarray
    key: np.ndarray
    mark: np.ndarray
    rep: np.ndarray
    code: np.ndarray
    more: list[np.ndarray]


class Search(NamedTuple):
    """A way to find candidates.

    ``shingle``: words of a shingle; ``code``: the code of a set, given its sorted hashes; ``size``: its bytes in a bucket. ``rows(reps, names)``:
    ``key`` and the columns ``names`` of ``reps`` (rep, code, ...), a row for each bucket of a set. ``pairs(group, wanted)``: i, j and their
    distance, for candidates in groups. ``tiers``: besides its nearest, a set is first compared with the first of those below it within each.
    """

    shingle: int
    code: Callable[[np.ndarray], bytes]
    size: int
    rows: Callable[[DataFrame, list[str]], DataFrame]
    pairs: Callable[[Group, Wanted], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    tiers: tuple[int, ...]


def shingles(text: str, n: int) -> np.ndarray:
    """A hash of each run of n words, repeats included; fewer words are one shingle."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), dtype=np.uint64)


def sketch(members: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Two sets differ in at least as many members as their sketches do in bits."""
    odd = np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def can_be_alike(n_i: np.ndarray, n_j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` members at least may be alike."""
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (n_i + n_j)


def fit(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be alike."""
    return 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])


def are_alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return x


def forest(n: int, pairs: Pairs) -> np.ndarray:
    """The position that stands for the component of each of n positions under links ``pairs``."""
    parent = np.arange(n)
    for i, j in pairs:
        a, b = roots(parent, i), roots(parent, j)
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
            x, y = root(parent, x), root(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        parent = roots(parent, parent)
    return parent


def edges_to(rep: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    """An edge from each position to the one that stands for it."""
    own = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[parent[own]])], names=["a", "b"])


def _part(n: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.col(n))


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def dealt(reps: DataFrame, rows_of: Callable[[DataFrame, list[str]], DataFrame], *more: str) -> tuple[DataFrame, bool]:
    """Rows ``key, part, split, rep, code`` and the columns ``more``, in the order of key and part; and whether a bucket was split.

    A bucket over PART rows is dealt out to parts, each row to one of them. Its first row goes to every part, so that
    what is near to it meets there; other pairs of a split bucket may not meet (see dealt_again).
    """
    names = ["rep", "code", *more]
    rows = rows_of(reps, names)
    counts = rows_of(reps, ["rep"]).groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).filter(F.col("n") > PART)
    large = durable(counts.select("key", F.ceil(F.col("n") / PART).alias("parts"), "first"))
    split = not large.isEmpty()
    if split:
        met = rows.join(large, "key", "left")
        own = F.when(F.col("rep") == F.col("first"), _upto("parts")).otherwise(F.array(F.coalesce(_part("parts"), F.lit(0).cast("long"))))
        out = met.select("key", F.explode(own).alias("part"), F.col("parts").isNotNull().alias("split"), *names)
    else:
        out = rows.select("key", F.lit(0).cast("long").alias("part"), F.lit(False).alias("split"), *names)
    return out.repartition("key", "part").sortWithinPartitions("key", "part", "rep"), split


def dealt_again(reps: DataFrame, rows_of: Callable[[DataFrame, list[str]], DataFrame], *more: str) -> DataFrame:
    """Rows ``key, part, side, rep, code`` and the columns ``more``, one of which is ``label``: groups in which each pair of rows
    of a bucket whose labels differ meets.

    Buckets with one label are left out. In a bucket over PART rows, those of the most common label needn't meet each other: they are
    dealt out to parts once for each part of the rest, and the rest alone is dealt out as pairs of its parts.
    In a group of both, ``side`` is 1 for the rest and 2 for the common label, else 0; equal sides above 0 needn't be compared.
    """
    names = ["rep", "code", *more]
    rows, marked = rows_of(reps, names), rows_of(reps, ["rep", "label"])
    mixed = durable(marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key", "n"))
    small = rows.join(mixed.filter(F.col("n") <= PART).select("key"), "key").select("key", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), *names)
    large = mixed.filter(F.col("n") > PART)
    if large.isEmpty():
        out = small
    else:
        labels = marked.join(large.select("key", "n"), "key").groupBy("key", "label", "n").agg(F.count("*").alias("of_label"))
        common = labels.groupBy("key", "n").agg(F.max(F.struct("of_label", "label")).alias("most"))
        common = durable(common.select("key", F.col("most.label").alias("common"), F.ceil(F.col("most.of_label") / PART).alias("pm"), F.ceil((F.col("n") - F.col("most.of_label")) / PART).alias("pr")))
        met = rows.join(common, "key").withColumns({"m": _part("pm"), "r": _part("pr")})
        group = lambda part, side: F.struct(part.alias("part"), F.lit(side).alias("side"))
        across = lambda r, m: F.col("pr") * F.col("pr") + r * F.col("pm") + m
        of_common = F.transform(_upto("pr"), lambda r: group(across(r, F.col("m")), 2))
        with_rest = F.transform(_upto("pr"), lambda r: group(F.least(F.col("r"), r) * F.col("pr") + F.greatest(F.col("r"), r), 0))
        with_common = F.transform(_upto("pm"), lambda m: group(across(F.col("r"), m), 1))
        groups = F.when(F.col("label") == F.col("common"), of_common).otherwise(F.concat(with_rest, with_common))
        out = small.unionByName(met.select("key", F.explode(groups).alias("g"), *names).select("key", "g.part", "g.side", *names))
    return out.repartition("key", "part").sortWithinPartitions("key", "part", "rep")


def apart(g: Group, label: np.ndarray) -> Wanted:
    """Pairs that are to be compared in a group of dealt_again."""
    return lambda i, j: (label[i] != label[j]) & ((g.mark[i] != g.mark[j]) | (g.mark[i] == 0))


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Group]:
    """Groups of rows dealt out, with codes of ``size`` bytes; those that lie whole in a batch come together."""
    kept = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
        new.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8).reshape(-1, size))
        new += [c.to_numpy(zero_copy_only=False) for c in batch.columns[5:]]
        columns = [np.concatenate([k, c]) for k, c in zip(kept, new, strict=True)] if kept else new
        last = np.flatnonzero(_changes(*columns[:2]))
        end = int(last[-1]) + 1 if len(last) else 0
        if end:
            yield _numbered([c[:end] for c in columns])
        kept = [c[end:] for c in columns]
    if kept and len(kept[0]):
        yield _numbered(kept)


def _changes(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (key[1:] != key[:-1]) | (part[1:] != part[:-1])


def _numbered(columns: list[np.ndarray]) -> Group:
    key, part, mark, rep, code, *more = columns
    return Group(np.cumsum(np.r_[True, _changes(key, part)]), key, mark, rep, code, more)


def _least(group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """For each distinct value of ``group``: the position of its row that is first by ``by``."""
    order = np.lexsort((*reversed(by), group))
    return order[np.r_[True, group[order][1:] != group[order][:-1]]] if len(order) else order


def first_candidates(reps: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """``a, b`` with a < b: for each row of ``rep, code, n`` its nearest candidate, and its first ones within each of the tiers; and
    ``node``: every row that has a candidate, or may have one in another part of a split bucket."""
    size, pairs_of, within = search.size, search.pairs, search.tiers

    def finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, size):
            n = g.more[0].astype(np.int64)
            near_d, near_a = np.full(len(n), 1 << 20), np.full(len(n), -1)
            least = np.full((len(within), len(n)), -1)  # rows are sorted by rep in a group
            for i, j, far in pairs_of(g, lambda i, j, n=n: fit(n, i, j)):
                for x, y in ((i, j), (j, i)):
                    best = _least(x, far, y)
                    x, y, d = x[best], y[best], far[best]
                    nearer = d < near_d[x]
                    near_d[x[nearer]], near_a[x[nearer]] = d[nearer], y[nearer]
                for k, tier in enumerate(within):
                    own, low = j[far <= tier], i[far <= tier]
                    best = _least(own, low)
                    own, low = own[best], low[best]
                    before = least[k, own]
                    least[k, own] = np.where(before < 0, low, np.minimum(before, low))
            at = np.flatnonzero((near_a >= 0) | g.mark.astype(bool))
            name = lambda p, at=at, g=g: pa.array(g.rep[p[at]], mask=p[at] < 0)
            yield pa.RecordBatch.from_arrays([pa.array(g.rep[at]), pa.array(near_d[at]), name(near_a), *(name(x) for x in least)], names=["node", "far", "near", *tiers])

    tiers = [f"least{t}" for t in within]
    rows, _ = dealt(reps, search.rows, "n")
    found = rows.mapInArrow(finding, f"node long, far long, near long, {', '.join(f'{t} long' for t in tiers)}")
    found = durable(found.groupBy("node").agg(F.min(F.struct("far", "near")).alias("best"), *(F.min(t).alias(t) for t in tiers)))
    other = F.explode(F.array_distinct(F.filter(F.array("best.near", *tiers), lambda x: x.isNotNull())))
    pairs = found.select(F.col("node").alias("a"), other.alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), found.select("node")


def open_forest(reps: DataFrame, search: Search) -> DataFrame:
    """``a, b``: edges that join all rows of ``rep, code, n, label, sketch`` that are candidates of each other and whose labels
    differ, but for those whose sketches show that they can't be alike. A group yields a forest, never its pairs."""
    size, pairs_of = search.size, search.pairs

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, size):
            n, label = (x.astype(np.int64) for x in g.more[:2])
            sketches = np.frombuffer(b"".join(g.more[2]), dtype=np.uint64).reshape(len(n), -1)
            differ = apart(g, label)

            def still(n: np.ndarray = n, sketches: np.ndarray = sketches, differ: Wanted = differ, g: Group = g) -> Pairs:
                for i, j, _ in pairs_of(g, lambda i, j: fit(n, i, j) & differ(i, j)):
                    can = can_be_alike(n[i], n[j], np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64))
                    yield i[can], j[can]

            yield edges_to(g.rep, forest(len(n), still()))

    return dealt_again(reps, search.rows, "n", "label", "sketch").mapInArrow(joining, "a long, b long").distinct()


def _widths(n: np.ndarray) -> np.ndarray:
    """Bits of the sketches by which sets of these sizes are compared: at least 8 for each member, a power of two."""
    return 8 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)


def settled(sets: list[np.ndarray], label: np.ndarray, mark: np.ndarray) -> list[tuple[int, int]]:
    """Positions i, j of sets that are alike: enough of them to join all that are alike or of one label.

    Sketches whose width grows with the sets rule out most pairs that aren't alike; the sets decide on the others, unless
    they are joined already. Sides as in dealt_again.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    n, label, mark = n[order], label[order], mark[order]
    width, parent, out = _widths(n), np.unique(label, return_index=True, return_inverse=True), []
    parent = parent[1][parent[2]]
    whole, halves = {}, {}
    for w in np.unique(width).tolist():
        of = np.stack([np.frombuffer(sketch(sets[p], w), dtype=np.uint64) for p in order[width == w]])
        whole[w] = of
        halves[w] = of[:, : w // 128] ^ of[:, w // 128 :]  # a member falls on the same place of either half
    first = {w: int(np.searchsorted(width, w)) for w in whole}
    for i in range(len(n)):
        end = int(np.searchsorted(n, n[i] * 100 // PERCENT, side="right"))
        w, own = int(width[i]), whole[int(width[i])][i - first[int(width[i])]]
        same = min(end, first[w] + len(whole[w]))
        bits = [np.bitwise_count(whole[w][i + 1 - first[w] : same - first[w]] ^ own).sum(axis=1, dtype=np.int64)]
        if end > same:  # sizes this near differ by one width at most
            bits.append(np.bitwise_count(halves[2 * w][: end - same] ^ own).sum(axis=1, dtype=np.int64))
        j = np.arange(i + 1, end)
        can = can_be_alike(n[i], n[j], np.concatenate(bits)) & ((mark[j] != mark[i]) | (mark[i] == 0)) & (roots(parent, j) != root(parent, i))
        for k in j[can].tolist():
            a, b = root(parent, i), root(parent, k)
            if a != b and are_alike(sets[order[i]], sets[order[k]]):
                parent[max(a, b)] = min(a, b)
                out.append((int(order[i]), int(order[k])))
    return out


def settle(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links of alike sets among rows of ``rep, n, label, cluster``, enough to join all that are alike in a cluster.

    ``sets`` has ``node, members``. A cluster over PART rows or MEMBERS members is dealt out as pairs of its parts.
    """

    def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([*(kept or []), batch])
            last = np.flatnonzero(_changes(table["cluster"].to_numpy(), table["part"].to_numpy()))
            cuts = [0, *(last + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield links_of(table.slice(a, b - a))
            kept = table.slice(cuts[-1]).to_batches()
        if kept:
            yield links_of(pa.Table.from_batches(kept))

    def links_of(group: pa.Table) -> pa.RecordBatch:
        made = [np.frombuffer(m.as_buffer(), dtype=np.uint64) for m in group["members"]]
        rep, label, side = (group[c].to_numpy() for c in ("rep", "label", "side"))
        pairs = np.array(settled(made, label, side), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rep[pairs[:, 0]]), pa.array(rep[pairs[:, 1]])], names=["a", "b"])

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long")).alias("all"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("rows") / PART), F.ceil(F.col("all") / MEMBERS)).alias("parts"))
    own = clusters.join(sizes, "cluster").withColumn("r", _part("parts"))
    group = lambda r: F.struct((F.least("r", r) * F.col("parts") + F.greatest("r", r)).alias("part"), F.when(F.col("r") == r, 0).when(F.col("r") < r, 1).otherwise(2).alias("side"))
    rows = own.join(sets, own["rep"] == sets["node"]).select("cluster", F.explode(F.transform(_upto("parts"), group)).alias("g"), "rep", "label", "members")
    rows = rows.select("cluster", "g.part", "g.side", "rep", "label", "members").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "rep")
    return rows.mapInArrow(comparing, "a long, b long").distinct()


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, members: sorted hashes) are alike."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [are_alike(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in both)) for both in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # many pairs may share a, few share b: so the set of b is the one that travels with the pair
    of_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
    both = of_b.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(compared, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of ``edges`` (a, b) reaches. Nodes without edges are left out.

    In each round a node takes the least of itself and its neighbours, then what that one has taken, and so on to the
    end, twice as far each time; edges are rewritten to what their ends have taken, and those inside one label go. What is
    left has half the nodes at most, and no round joins all edges again. Every round is written to the shared folder; what is
    joined is read from there, so that adaptive execution can split the rows of a node with many edges.
    """
    with scratch(edges.sparkSession) as written:
        edges = written(edges.select("a", "b").filter("a <> b").distinct())
        nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        labels = written(nodes.withColumn("label", F.col("node")))
        while not edges.isEmpty():
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            took = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("old"), F.least("a", "least").alias("new")))
            more = True
            while more:
                further = written(took.alias("t").join(took.alias("u"), F.col("t.new") == F.col("u.old")).select("t.old", "u.new", F.col("t.new").alias("was")))
                more, took = not further.filter("new <> was").isEmpty(), further.drop("was")
            moved = lambda df, c, took=took: df.join(took, df[c] == took["old"]).drop("old", c).withColumnRenamed("new", c)
            edges = written(moved(moved(edges, "a"), "b").filter("a <> b").distinct())
            kept = labels.join(took, labels["label"] == took["old"], "left")
            labels = written(kept.select("node", F.coalesce("new", "label").alias("label")))
        return labels


def nodes(df: DataFrame, id_col: str, text_col: str, shingle: int, code: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``_id, _h1, _h2, node, n, code, sketch`` of every row: its keys (see marks), and hash, size, code and sketch of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(3)).to_pylist(), 4_000_000):
                sets = [np.unique(shingles(t, shingle)) for t in batch.column(3).slice(a, b - a).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                columns = [pa.array(node), pa.array([len(s) for s in sets], pa.int32()), *(pa.array([f(s) for s in sets], pa.binary()) for f in (code, sketch))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:3]), *columns], names=["_id", "_h1", "_h2", "node", "n", "code", "sketch"])

    rows = df.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in marks(text_col).items()), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {df.schema[id_col].dataType.simpleString()}, _h1 long, _h2 long, node long, n int, code binary, sketch binary")


def _sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n: int) -> DataFrame:
    """``node, members`` for the rows named by ``wanted`` (_id, _h1, _h2, node): the sorted hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), 4_000_000):
                made = [np.unique(shingles(t, n)).tobytes() for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.binary())], names=["node", "members"])

    rows = df.select(F.col(id_col).alias("_own"), *(c.alias(k) for k, c in marks(text_col).items()), text_or_empty(text_col).alias("_text"))
    found = rows.join(wanted, rows["_own"].eqNullSafe(wanted["_id"]) & (rows["_h1"] == wanted["_h1"]) & (rows["_h2"] == wanted["_h2"]))
    return found.select("node", "_text").mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def alike_components(df: DataFrame, id_col: str, text_col: str, shingle: int, code: Callable[[np.ndarray], bytes], search_of: Callable[[DataFrame], Search]) -> DataFrame:
    """``_id, _h1, _h2, n, label`` of every row; rows of one label are joined by links of texts alike to PERCENT or more.

    ``search_of`` makes the search for a table of ``rep, n, code, sketch``, a row for each distinct set; each candidate pair that it finds is
    either compared or already joined. Sets without members have one label.
    """
    rows = durable(nodes(df, id_col, text_col, shingle, code))
    reps = durable(rows.filter("n > 0").groupBy(F.col("node").alias("rep")).agg(F.min(F.struct("_id", "_h1", "_h2")).alias("row"), *(F.first(c).alias(c) for c in ("n", "code", "sketch"))))
    search = search_of(reps)
    some, near_ones = first_candidates(reps, search)
    some, near_ones = durable(some), durable(reps.join(near_ones, reps["rep"] == near_ones["node"], "left_semi"))
    sets = durable(_sets(df, id_col, text_col, near_ones.select("row.*", F.col("rep").alias("node")), shingle))
    good = durable(alike(some, sets))
    joined = components(good)
    labelled = durable(near_ones.join(joined, near_ones["rep"] == joined["node"], "left").select("rep", "code", "n", "sketch", F.coalesce("label", "rep").alias("label")))
    clusters = components(open_forest(labelled, search)).withColumnRenamed("label", "cluster")
    more = durable(settle(labelled.join(clusters, labelled["rep"] == clusters["node"]).select("rep", "n", "label", "cluster"), sets))
    if not more.isEmpty():
        joined = components(good.unionByName(more))
    return rows.join(joined, "node", "left").select("_id", "_h1", "_h2", "n", F.coalesce("label", rows["node"]).alias("label"))


def first_of_each(rows: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each label of ``rows`` (_id, _h1, _h2, label): that with the smallest id, null ids last."""
    rows = durable(rows.groupBy("label", "_id", "_h1", "_h2").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("_id").isNull().alias("unknown"), "_id", "_h1", "_h2")
    first = durable(rows.groupBy("label").agg(F.min(order).alias("first"), F.sum("copies").alias("all")).filter("all > 1"))
    decided = durable(rows.join(first, "label").select("_id", "_h1", "_h2", "copies", order.eqNullSafe(F.col("first")).alias("kept")))
    gone, once = (decided.filter(c).select("_id", "_h1", "_h2") for c in ("not kept", "kept and copies > 1"))
    return without(df, id_col, text_col, gone, once)
