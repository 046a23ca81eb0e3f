"""Byte-level BPE encoding and decoding.

The ``tokenizers`` library encodes the distinct pre-tokens of each Arrow batch; bytes are shown to it as
characters by the usual byte-to-character table, and decoding reverses that table. Vocabulary files stay
where they are: the driver reads the rank file (its size is fixed) and the tasks get its bytes.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from .common import slices, text_or_empty

#: Text handled at once in a task, and pre-tokens remembered by a worker.
SLICE_CHARS = 2_000_000
REMEMBERED = 500_000


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE over a rank file (lines of base64 token and rank), splitting by ``pattern`` first."""

    def __init__(self, ranks: bytes, pattern: str):
        rank = {base64.b64decode(token): int(n) for token, n in map(bytes.split, ranks.splitlines())}
        chars = byte_table()
        shown = {token: "".join(chars[b] for b in token) for token in rank}
        # every split of a token into two tokens merges at the token's own rank
        merges = [
            (shown[token[:i]], shown[token[i:]])
            for token in sorted(rank, key=rank.__getitem__)
            for i in range(1, len(token))
            if token[:i] in rank and token[i:] in rank
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: n for t, n in rank.items()}, merges=merges, ignore_merges=True))
        self.split = regex.compile(pattern).findall
        reverse = {c: b for b, c in enumerate(chars)}
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = [bytes(reverse[c] for c in self.tokenizer.id_to_token(i)) for i in range(size)]
        self.n_bytes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.shown = dict(enumerate(chars))
        #: ids of pre-tokens seen before, as the bytes of 32-bit numbers
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        pieces = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {*chain.from_iterable(pieces)}.difference(self.known)
        tokenize, shown, known = self.tokenizer.model.tokenize, self.shown, self.known
        for piece in new:
            known[piece] = array("i", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(shown))]).tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), dtype=np.int32) for p in pieces]
        for piece in new:
            if len(piece) > 200:  # runs of one class can be as long as a text; they aren't worth remembering
                del known[piece]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in code points; tokens that share a split character both cover it."""
        ends = np.cumsum(self.n_bytes[ids])
        starts = ends - self.n_bytes[ids]
        if not text.isascii():
            lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            starts, ends = char[starts], char[ends - 1] + 1
        return np.stack([starts, ends], axis=1).astype(np.int32)


@functools.lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays) if arrays else [], type=kind))


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = True, with_decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: the id column, ``tokens``, and what is asked for of ``starts``, ``ends``
    (code points that each token covers) and ``decoded`` (the bytes that the ids decode to).

    Null and empty texts have no tokens. Rows are kept as they are, repeated ones too; other columns are
    left out, so their names can't clash. Special tokens don't exist here: their strings are plain text.
    """
    ranks = _rank_bytes(ranks_path)
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    if with_offsets:
        fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("starts", "ends")]
    if with_decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in slices(sizes, SLICE_CHARS):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                tokens = bpe.encode(texts)
                columns = [batch.column(0).slice(a, b - a), _lists(tokens, pa.int32())]
                if with_offsets:
                    spans = [bpe.offsets(t, i) for t, i in zip(texts, tokens, strict=True)]
                    columns += [_lists([s[:, k] for s in spans], pa.int32()) for k in (0, 1)]
                if with_decoded:
                    columns.append(pa.array([bpe.decode(i) for i in tokens], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(id_col, text_or_empty(text_col).alias("_text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "tokens") -> DataFrame:
    """``decoded`` (bytes) and ``text`` of each row's token ids. Ids outside the vocabulary are an error; null ids
    decode to nothing. Bytes that are no whole character (a list that was cut) become U+FFFD in ``text`` only."""
    ranks = _rank_bytes(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            raw = [bpe.decode(np.asarray(ids, dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            texts = [r.decode("utf-8", "replace") for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, type=pa.binary()), pa.array(texts, type=pa.string())], names=[id_col, "decoded", "text"])

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids")
    schema = T.StructType([df.schema[id_col], T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())])
    return df.select(id_col, ids).mapInArrow(run, schema)


def digest(df: DataFrame, ranks_path: str, pattern: str, with_tokens: bool = False) -> DataFrame:
    """Round trip of every text of a documents table, as digests of its ids and of what they decode to; the ids too
    ``with_tokens``."""
    coded = encode(df, ranks_path, pattern, with_offsets=False, with_decoded=True)
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["tokens"] if with_tokens else []),
    )
