import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgrid.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RAW = open(PATH, "rb").read()
CODEC = bpe.ByteBpe(RAW, PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_and_round_trip(text):
    ids = CODEC.encode([text])[0]
    assert ids.tolist() == REFERENCE.encode_ordinary(text) and CODEC.decode(ids) == text.encode()
    spans = CODEC.offsets(text, ids)
    for (a, b), i in zip(spans.tolist(), ids.tolist(), strict=True):
        assert CODEC.bytes_of[i] in text[a:b].encode()


def test_runs_and_joined_tokens():
    rng = random.Random(0)
    tokens = list(RANKS)
    for _ in range(3000):
        text = b"".join(rng.choice(tokens) for _ in range(4)).decode("utf-8", "ignore") + rng.choice("=-a e_") * rng.randint(0, 90)
        assert CODEC.encode([text])[0].tolist() == REFERENCE.encode_ordinary(text)


def expected(text):
    ids = REFERENCE.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


@pytest.mark.parametrize("table", ["docs", "small"])
def test_digest(table, request):
    df = request.getfixturevalue(table)
    got = sorted(map(tuple, bpe.digest(df, PATH, PATTERN).collect()))
    assert got == sorted((r["doc_id"], *expected(r["text"])) for r in df.collect())


def test_decode_and_empty(spark, nothing):
    ids = REFERENCE.encode_ordinary("a😀b")
    df = spark.createDataFrame([(1, ids), (2, ids[:2]), (3, None), (4, [])], "doc_id long, tokens array<int>")
    got = {r["doc_id"]: (bytes(r["decoded"]), r["text"]) for r in bpe.decode(df, PATH, PATTERN).collect()}
    assert got[1] == ("a😀b".encode(), "a😀b") and got[3] == got[4] == (b"", "") and "�" in got[2][1]
    assert bpe.encode(nothing, PATH, PATTERN).count() == 0
