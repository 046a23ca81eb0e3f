import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetgrid.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(sizes):
    """Share by weight, cap, reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    pool, target = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0)
    open_ = set(order)
    while open_:
        left = pool - sum(target[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
        open_ -= above
    return target


@pytest.mark.parametrize("table", ["docs", "small"])
def test_targets_are_met(table, request):
    df = request.getfixturevalue(table)
    got = mixing.mix(df, block=64).collect()
    rows = df.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    target = brute_targets(sizes)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_reruns_agree_over_other_partitions(small):
    a = mixing.mix(small.repartition(7)).collect()
    b = mixing.mix(small.coalesce(1)).collect()
    assert sorted(a) == sorted(b)


def test_documents_of_the_mix(docs, small):
    for df in (docs.dropDuplicates(["doc_id"]), small):
        out = mixing.mixed_documents(df, block=64)
        assert out.columns == df.columns
        n = {r["doc_id"]: r["taken"] for r in mixing.mix(df, block=64).collect()}
        got, texts = defaultdict(int), {r["doc_id"]: r["text"] for r in df.collect()}
        for r in out.collect():
            got[r["doc_id"]] += len(words(r["text"]))
            assert len(r["text"]) == r["n_chars"] or r["text"] == texts[r["doc_id"]]
            it = iter(words(texts[r["doc_id"]]))
            assert all(w in it for w in words(r["text"]))
        assert got == {i: k for i, k in n.items() if k}


def test_permutation(spark):
    for n in (1, 2, 3, 7, 100, 1013):
        df = spark.range(n).selectExpr("id AS at", f"{n}L AS n", "12345L AS k")
        image = [r["image"] for r in mixing.permuted(df, "at", "n", "k", "image").orderBy("at").collect()]
        assert sorted(image) == list(range(n)) and (n < 100 or image != list(range(n)))


def test_nothing_and_no_words(spark, nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 3


def test_a_source_with_a_third_of_the_rows(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 50))").alias("source"))
    got = mixing.mix(df, block=16).withColumn("over", F.col("taken") > 2 * F.col("size"))
    assert got.filter("over").count() == 0


def test_documents_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"t{i}w{k}" for k in range(20 + 7 * i)) for i in range(30)]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    rows += [(5, texts[1], "b"), (5, texts[1], "a"), (None, "same text here", None), (None, "same text here", None), (9, " ", "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, got = mixing.mixed_documents(df, block=16).collect(), defaultdict(int)
    own = defaultdict(int)
    for i, t, s in rows:
        for w in words(t):
            own[i, s, w] += 1
    taken = defaultdict(int)
    for r in out:
        assert any(r["doc_id"] == i and r["source"] == s and {*words(r["text"])} <= {*words(t)} for i, t, s in rows)
        for w in words(r["text"]):
            got[r["doc_id"], r["source"], w] += 1
            taken[r["source"]] += 1
    assert all(n <= mixing.TIMES * own[k] for k, n in got.items())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_rows_without_ids_are_dealt_out(spark, monkeypatch):
    """Rows of one source that all lack an id, many of them equal: places are gapless, and no bucket holds them all."""
    from pyspark.sql import functions as F

    rows = [(None, "a b c" if i % 2 else " ".join(f"w{i}" for _ in range(1 + i % 7)), "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for crowded in (8, 1):
        monkeypatch.setattr(mixing, "CROWDED", crowded)
        placed = mixing.Mix(df).documents.collect()
        at = 0
        for r in sorted(placed, key=lambda r: (r["start"], r["size"])):
            assert r["start"] == at
            at += r["size"]
        assert len(placed) == 3000
    got = mixing.mix(df)
    total = got.agg(F.sum("size").alias("n"), F.sum("taken").alias("t"), F.max(F.expr("taken - 2 * size")).alias("over")).first()
    assert total["n"] == at and abs(total["t"] - 1.5 * at) <= 1 and total["over"] <= 0
