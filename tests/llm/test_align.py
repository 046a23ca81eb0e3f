import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetgrid.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*(open(p, "rb").read() for p in (A, B)))


def plain(rows):
    """Rows by loops over whole texts."""
    a_of, b_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    shown = {c: b for b, c in enumerate(align.byte_table())}
    docs, counts = [], Counter()
    for key, text in rows:
        a = a_of.encode(f" {text or ''}", add_special_tokens=False).ids
        b = b_of.encode(text or "")
        a_bytes = [bytes(shown[c] for c in a_of.id_to_token(i)) for i in a]
        pieces = [b_of.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:-1], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
            docs.append((key, 0, 0, [], []))
            continue
        end_a, end_b = {}, {}
        for ends, tokens in ((end_a, a_bytes), (end_b, b_bytes)):
            at = 0
            for i, t in enumerate(tokens):
                at += len(t)
                ends[at] = i
        links, groups, x, y = [], [], 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            i, j = end_a[end], end_b[end]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        counts.update(links)
        docs.append((key, len(a), len(b), links, groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    return [
        (key, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for key, n_a, n_b, links, groups in docs
    ]


ODD = [
    " two  spaces  and a lead", "tail ", "\n", "a\nb \tc", "x▁y", "</s> <|endoftext|> <s> <0x41>", " nbsp   x", "é è ü ß", "a ́b", "a\u0000b", "é ​ zero", "中文 字符 😀 \U0001f468‍\U0001f469",
    "don't I'll we've 's", "1 22 333 4444", "a" * 3000, " ", "   ", "x   ", "\u0085 y", "ﬁ ½ ①", "word", "over­soft", "«quoted» ¡hola! ¿qué?", "a\x1cb \x1c c",
]


def encoded(pair, texts):
    for text, *ids in zip(texts, *(np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in pair.encode(texts)), strict=True):
        if "▁" in text:  # it doesn't come back
            assert not len(ids[0]) and not len(ids[1])
        else:
            yield text, *ids


def order(rows):
    return sorted(map(str, map(tuple, rows)))


def test_words_are_encoded_as_whole_texts(pair):
    for _ in range(2):  # with nothing known, and with words known
        for text, a, b in encoded(pair, ODD):
            assert a.tolist() == pair.a.encode(f" {text}", add_special_tokens=False).ids and b.tolist() == pair.b.encode(text), text
    rng = np.random.default_rng(3)
    pieces = [*" ", " ", " ", "a", "the", "Ü", "é", "́", "\n", "\t", "'s", "7", "!", "▁", " ", "中", "😀", "</s>", "‍"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 30))) for _ in range(3000)]
    for text, a, b in encoded(pair, texts):
        assert a.tolist() == pair.a.encode(f" {text}", add_special_tokens=False).ids and b.tolist() == pair.b.encode(text), text


def test_lockstep_finds_common_ends():
    rng = np.random.default_rng(4)
    ends, a_first, b_first, want_a, want_b = [[], []], [], [], [], []
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (sorted({*rng.integers(1, total + 1, rng.integers(0, 30)).tolist(), total}) for _ in range(2))
        a_first.append(len(ends[0]))
        b_first.append(len(ends[1]))
        want_a += [a_first[-1] + i for i, x in enumerate(a) if x in b]
        want_b += [b_first[-1] + i for i, x in enumerate(b) if x in a]
        ends[0] += a
        ends[1] += b
    got = align.lockstep(*(np.array(x) for x in (*ends, a_first, b_first)))
    assert got[0].tolist() == want_a and got[1].tolist() == want_b


def test_same_rows_as_by_loops(spark, docs, small, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, t) for t in ODD] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a long, batch string").repartition(3)
    monkeypatch.setattr(align, "BATCH_BYTES", 50_000)
    got = align.align(df, A, B)
    assert order(got.collect()) == order(plain(rows))
    assert align.align(df.limit(0), A, B).count() == 0
    every = small.select("doc_id", "text")
    assert order(align.align(every, A, B).collect()) == order(plain(every.collect()))
