"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often their ids do so.

All documents of a batch are merged in lockstep. One NumPy state vector holds a pointer into the tokens of A and one into
those of B for each document; each step moves the pointer whose token ends first, or both, in all documents at once. Where
both tokens end together there is a link and a cut. Documents that have ended leave the vector.

Words are told apart where no token of either tokenizer can cross, so that the libraries encode each distinct word of a batch once.
Counts of linked ids come back to batches by a join on the ids, of which each batch names every pair once; links never leave
their batch. Vocabulary files stay where they are: the driver reads them (their size is fixed) and tasks get their bytes.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..sources.shared import written
from .bpe import byte_table
from .common import slices, text_or_empty

#: Text of a batch in bytes, a longer text is a batch by itself; and distinct words encoded at once.
BATCH_BYTES = 4_000_000
AT_ONCE = 10_000
#: Characters that are no white space, mark or control in any version of Unicode: between two of them, no token crosses a space.
PLAIN = "[!-~À-ÖØ-öø-ÿ]"
CUT = re.compile(f" (?<={PLAIN} )(?={PLAIN})")


class Pair:
    """Tokenizers A (a ``tokenizers`` file, byte-level) and B (a ``sentencepiece`` model), and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only wait for each other
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True  # strings of special tokens in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte_of = {c: b for b, c in enumerate(byte_table())}
        a_tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in a_tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in of], dtype=np.int32) for of in (self.a_bytes, self.b_bytes)]
        #: ids of A and what follows them, then those of B
        self.names = np.array([f"{i}{end}".encode() for of, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(of)) for end in ends])
        #: whether no piece of B holds a space behind another character, so that none crosses the space before a word
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def _tokens(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A (of a space and each word) and B (which adds the space): ids, their number in each word, and whether their bytes are the word's."""
        ids: list[list[list[int]]] = [[], []]
        for k in range(0, len(words), AT_ONCE):
            part = words[k : k + AT_ONCE]
            ids[0] += [x.ids for x in self.a.encode_batch_fast([f" {w}" for w in part], add_special_tokens=False)]
            ids[1] += self.b.encode(part, num_threads=1)
        out = []
        for of, names in zip(ids, (self.a_bytes, self.b_bytes), strict=True):
            many = np.fromiter(map(len, of), dtype=np.int64, count=len(of))
            same = [b"".join(map(names.__getitem__, x)) == f" {w}".encode() for w, x in zip(words, of, strict=True)]
            out.append((np.fromiter(chain.from_iterable(of), dtype=np.int32, count=many.sum()), many, np.array(same, dtype=bool)))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: token ids of a space and each text, one text behind the other, and their number in each text. Texts whose
        tokens don't give back a space and the text have none."""
        # a space at a cut belongs to the word behind it
        words = [CUT.split(t) if self.splits else [t] for t in texts]
        coded = pa.array(chain.from_iterable(words), pa.large_string()).dictionary_encode()
        place, first = coded.indices.to_numpy(), _starts(np.array([*map(len, words)], dtype=np.int64))
        if not texts:
            return 2 * [(place, first)]
        tokens = self._tokens(coded.dictionary.to_pylist())
        out = []
        for ids, many, _ in tokens:
            sizes = many[place]
            within = np.arange(sizes.sum()) - np.repeat(_starts(sizes), sizes)
            out.append((ids[np.repeat(_starts(many)[place], sizes) + within], np.add.reduceat(sizes, first)))
        good = np.logical_and.reduceat((tokens[0][2] & tokens[1][2])[place], first)
        for k in np.flatnonzero(~good).tolist():
            good[k] = all(b"".join(map(of.__getitem__, x[:end][-n:].tolist())) == f" {texts[k]}".encode() for of, (x, c) in zip((self.a_bytes, self.b_bytes), out, strict=True) for end, n in [(int(c[: k + 1].sum()), int(c[k]))])
        return [(ids[np.repeat(good, counts)], counts * good) for ids, counts in out]


@functools.lru_cache(maxsize=1)
def pair(a_file: bytes, b_file: bytes) -> Pair:
    return Pair(a_file, b_file)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of A and of B that end together, in order.

    The ends are those of the tokens of all documents, one document behind the other, counted from the document's start;
    a document's tokens begin at ``a_first`` and ``b_first``. Documents have tokens, and their last ones end together.
    """
    a, b = a_first.copy(), b_first.copy()
    last = np.r_[a_first[1:], len(a_ends)] - 1
    links_a, links_b = [a[:0]], [b[:0]]
    while len(a):
        end_a, end_b = a_ends[a], b_ends[b]
        cut = end_a == end_b
        links_a.append(a[cut])
        links_b.append(b[cut])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        alive = a <= last
        if not alive.all():
            a, b, last = a[alive], b[alive], last[alive]
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _ends(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each token ends in its document."""
    total = np.cumsum(sizes)
    first = _starts(counts)
    before = np.where(first > 0, total[first - 1], 0) if len(total) else first
    return total - np.repeat(before, counts)


def _groups(of: Pair, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_links: np.ndarray) -> list[str]:
    """For each document the digest of its groups, ids of A before those of B; '' without groups."""
    end_a, end_b = np.zeros(len(a), dtype=np.int32), np.zeros(len(b), dtype=np.int32)
    end_a[cut_a], end_b[cut_b] = 1, 1
    # tokens of B in earlier groups stand before a token of A, tokens of A up to the end of its own group before one of B
    before_a = np.r_[0, cut_b + 1][np.cumsum(end_a) - end_a]
    before_b = (cut_a + 1)[np.cumsum(end_b) - end_b] if len(b) else end_b
    names = np.empty(len(a) + len(b), dtype=np.int32)
    names[np.arange(len(a)) + before_a] = 2 * a + end_a
    names[np.arange(len(b)) + before_b] = 2 * (b + len(of.a_bytes)) + end_b
    shown = of.names[names].view(np.uint8).reshape(len(names), -1)
    ends = np.r_[0, np.cumsum((shown != 0).sum(axis=1))]
    text = shown[shown != 0].tobytes()
    out, at, link = [], 0, 0
    for n in n_links.tolist():
        link += n
        end = int(ends[cut_a[link - 1] + cut_b[link - 1] + 2]) if n else at
        out.append(hashlib.sha256(text[at : end - 1]).hexdigest() if n else "")
        at = end
    return out


def aligned(of: Pair, ids: pa.Array, texts: pa.Array) -> tuple[pa.RecordBatch, np.ndarray]:
    """A row for each document (its id, counts and digest), and its links as pairs of ids in one number each."""
    written = [t or "" for t in texts.to_pylist()]
    (a, n_a), (b, n_b) = of.encode([t or "!" for t in written])
    there = np.array([*map(bool, written)], dtype=bool)
    a, b, n_a, n_b = a[np.repeat(there, n_a)], b[np.repeat(there, n_b)], n_a * there, n_b * there
    some = n_a > 0
    cut_a, cut_b = lockstep(_ends(of.sizes[0][a], n_a[some]), _ends(of.sizes[1][b], n_b[some]), _starts(n_a[some]), _starts(n_b[some]))
    n_links = np.zeros(len(n_a), dtype=np.int64)
    n_links[some] = np.diff(np.searchsorted(cut_a, np.r_[0, np.cumsum(n_a[some])])) if some.any() else 0
    digests = _groups(of, a, b, cut_a, cut_b, n_links)
    rows = pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (n_a, n_b, n_links, digests))], names=["doc_id", "n_a", "n_b", "n_links", "groups_sha256"])
    return rows, a[cut_a].astype(np.int64) << 32 | b[cut_b]


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between the tokens of two tokenizers, a row for each row of ``df``.

    ``n_a, n_b``: tokens of A (of a space and the text) and B (which adds the space). ``n_groups``: groups into which
    the ends that both have in common cut them, ``groups_sha256`` their digest. ``n_links``: pairs of tokens that end together;
    every token has bytes, so each group has one. A pair of ids counts as often as it is linked in all documents; ``n_best``: links
    whose count is the highest of their id of B, ties included; ``count_sum``: the counts of all links added up.

    Null and empty texts, and those whose tokens don't give back a space and the text, have zeros and ''. Repeated rows each stay
    and count; null ids stay. An empty table gives an empty result. Other columns are ignored.

    A batch of documents (BATCH_BYTES, or one longer document) is one row of a table in the shared folder. It names each of its
    pairs of ids once (they are numbered in the batch); counts of pairs, and the highest of each id of B (it has no more pairs than A has ids), are joined to them.
    """
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = pair(*files), TaskContext.get().partitionId() << 32
        for batch in batches:
            for s, e in slices(pc.binary_length(batch.column(1)).to_pylist(), BATCH_BYTES):
                rows, links = aligned(of, batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s))
                found = pa.array(links).dictionary_encode()
                counts = np.bincount(found.indices, minlength=len(found.dictionary))
                cells = [_packed(pa.table(x)) for x in ({c: rows[c] for c in rows.schema.names}, {"place": found.indices}, {"pair": found.dictionary, "n": counts})]
                yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([c], pa.binary()) for c in cells)], names=["batch", "rows", "links", "pairs"])
                n += 1

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, cell in zip(batch.column(0), batch.column(1), strict=True):
                table = _unpacked(cell)
                table = table.append_column("batch", pa.array(np.full(len(table), number.as_py(), dtype=np.int64))).append_column("at", pa.array(np.arange(len(table), dtype=np.int32)))
                yield from table.select(["batch", "at", "pair", "n"]).to_batches(max_chunksize=100_000)

    def counted(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["at"].to_numpy())
        count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order]
        rows, place = _unpacked(docs["rows"][0]), _unpacked(docs["links"][0])["place"].to_numpy()
        n = rows["n_links"].to_numpy()
        ends = np.cumsum(n)
        upto = lambda x: np.r_[0, np.cumsum(x[place])]
        sums = [t[ends] - t[ends - n] for t in (upto(best.astype(np.int64)), upto(count))]
        columns = [rows["doc_id"], rows["n_a"], rows["n_b"], rows["n_links"], rows["n_links"], *sums, rows["groups_sha256"]]
        return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text"))
    batches = written(texts.mapInArrow(linking, "batch long, rows binary, links binary, pairs binary"))
    named = batches.select("batch", "pairs").mapInArrow(listed, "batch long, at int, pair long, n long")
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = named.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_b))
    told = named.select("batch", "at", "pair").join(counts, "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return batches.select("batch", "rows", "links").groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(counted, schema)
