"""Language identification by rank-order profiles.

A text's most frequent letter n-grams are ranked and compared to the ranks in each language's profile; the language
with the least total displacement (out-of-place distance) is predicted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: N-grams in a profile, and the prediction for texts without a letter.
PROFILE, UNDETERMINED = 300, "und"
#: Languages that profiles may have, as each task knows them all. More of them are an error, not a cut.
LANGUAGES = 1000
#: Bits of a code point in an n-gram, which holds three of them at most, and the boundary mark.
CODE_BITS, BOUNDARY = 21, 0x20
#: Code points handled at once, and texts: a text's number shares a sort key with the n-grams of its slice.
SLICE_CHARS, SLICE_TEXTS = 1_000_000, 4000
#: Sums that a task holds before it adds up equal ones.
PENDING = 2_000_000


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, in order of text and n-gram: its number, the n-gram, and how often it stands there.

    N-grams are the runs of one to three letters inside a word with one boundary mark at either side of it;
    letters are lower-cased and all else is a boundary. An n-gram is its code points, 21 bits each, the first one highest.
    """
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), dtype=np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(c) for c in codes])
    code = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32)
    letter = _letters()[code]
    keep = letter | np.r_[False, letter[:-1]] | np.r_[letter[1:], False]
    code, doc, letter = np.where(letter, code, BOUNDARY)[keep], doc[keep], letter[keep]
    # code points that occur are numbered in their order from 1, so that text and n-gram fit one sort key
    seen = np.zeros(0x110000, dtype=bool)
    seen[code] = True
    alphabet = np.r_[0, np.flatnonzero(seen)]
    number = np.zeros(0x110000, dtype=np.int64)
    number[alphabet[1:]] = np.arange(1, len(alphabet))
    code, bits = number[code], int(len(alphabet)).bit_length()
    if 3 * bits + len(texts).bit_length() > 63:  # next to all letters that there are
        half = len(texts) // 2
        low, high = grams(texts[:half]), grams(texts[half:])
        return np.r_[low[0], high[0] + half], np.r_[low[1], high[1]], np.r_[low[2], high[2]]
    found = []
    for n in (1, 2, 3):
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = letter[:m].copy() if n == 1 else (letter[1:m + 1] if n == 3 else letter[:m] | letter[1:m + 1])
        ok &= doc[:m] == doc[n - 1 :]
        at = np.flatnonzero(ok)
        value = doc[at]
        for k in range(3):
            value = value << bits | (code[at + k] if k < n else 0)
        found.append(value)
    keys = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else keys
    n, key = np.diff(np.r_[first, len(keys)]), keys[first]
    gram = np.zeros(len(key), dtype=np.int64)
    for k in (2, 1, 0):
        gram = gram << CODE_BITS | alphabet[key >> k * bits & ((1 << bits) - 1)]
    return key >> 3 * bits, gram, n


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    sizes = (SLICE_CHARS // SLICE_TEXTS + n for n in pc.binary_length(batch.column(column)).to_pylist())
    for a, b in slices(sizes, SLICE_CHARS):
        yield a, b, batch.column(column).slice(a, b - a).to_pylist()


def profiles(df: DataFrame, lang_col: str, text_col: str, size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank`` (from 0): the most frequent n-grams of each language over all rows of ``df``.

    Rows without a language teach nothing. Tasks add up their own texts first, so what is shuffled is a row for each
    task, language and n-gram; ties of counts are broken by the n-gram's code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, pending = [(np.zeros(0, dtype=np.int64),) * 3], 0

        def added_up() -> None:
            lang, gram, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            first = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]) if len(lang) else order
            held[:] = [(lang[first], gram[first], np.add.reduceat(n, first) if len(first) else n)]

        for batch in batches:
            for a, b, texts in _batches(batch, 1):
                langs = np.array([names.setdefault(x, len(names)) for x in batch.column(0).slice(a, b - a).to_pylist()])
                doc, gram, n = grams(texts)
                held.append((langs[doc], gram, n))
                pending += len(n)
                if pending > PENDING:
                    added_up()
                    pending = 0
        added_up()
        lang, gram, n = held[0]
        known = np.array([*names, ""], dtype=object)
        for part in np.array_split(np.arange(len(lang)), max(1, len(lang) // 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(known[lang[part]], pa.string()), pa.array(gram[part]), pa.array(n[part])], names=["lang", "gram", "n"])

    rows = df.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("_text"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).filter(F.col("rank") < size).select("lang", "gram", "rank")


def predict(df: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, from its letters alone.

    The score is one less the distance over the largest possible distance. Texts that are null or have no letter are
    UNDETERMINED with score 0, as are all texts if no language was learned; ties go to the first language by name.
    Profiles have ``size`` rows for each language, and there are LANGUAGES of them at most: they go to the tasks as a table of ranks.
    """
    known = learned.limit(LANGUAGES * size + 1).collect()
    if len(known) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted({r["lang"] for r in known})
    ranks = [[(r["gram"], r["rank"]) for r in known if r["lang"] == n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.array(sorted({g for profile in ranks for g, _ in profile}), dtype=np.int64)
        # a column for each n-gram of any profile, and one for all others
        place = np.full((len(names), len(every) + 1), -1, dtype=np.int32)
        for k, profile in enumerate(ranks):
            of = np.array(profile, dtype=np.int64).reshape(-1, 2)
            place[k, np.searchsorted(every, of[:, 0])] = of[:, 1]
        for batch in batches:
            for a, b, texts in _batches(batch, 1):
                doc, gram, n = grams(texts)
                # most frequent first; n-grams come in order, and ties stay in it
                order = np.argsort(doc << 32 | ((1 << 32) - 1 - n), kind="stable")
                doc, gram = doc[order], gram[order]
                starts = np.searchsorted(doc, np.arange(len(texts) + 1))
                rank = np.arange(len(doc)) - starts[doc]
                top = rank < size
                doc, gram, rank = doc[top], gram[top], rank[top]
                column = np.searchsorted(every, gram)
                column[~np.isin(gram, every)] = len(every)
                n_top = np.bincount(doc, minlength=len(texts))
                far = np.stack([np.bincount(doc, np.where(p[column] < 0, size, np.abs(p[column] - rank)), len(texts)) for p in place]) if names else np.zeros((1, len(texts)))
                best = far.argmin(axis=0)
                some = (n_top > 0) & bool(names)
                langs = [names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, 1 - far.min(axis=0) / np.maximum(size * n_top, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("_text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that teach nothing: crc32 of the id as text leaves 1 when divided by 3. Null ids may teach."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the documents that aren't held out, applied to all.

    Null and empty texts are UNDETERMINED with score 0; rows with a null language teach nothing, null ids may teach; repeated
    rows stay and teach each time; texts of any length count whole; an empty table gives an empty result; other columns are ignored.
    """
    learned = profiles(df.filter(~held_out()), "lang", "text")
    return predict(df, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
