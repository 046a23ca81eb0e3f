import zlib
from collections import Counter

from pyspark.sql import functions as F

from fleetgrid.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_grams_match_a_plain_count():
    texts = ["Ab, ab! é", "", "123 ...", "a", "The QUICK brown\tfox the 中文"]
    doc, gram, n = langid.grams(texts)
    for i, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        want = Counter(g for w in words for g in [*w, *(f" {w} "[k : k + 2] for k in range(len(w) + 1)), *(f" {w} "[k : k + 3] for k in range(len(w)))])
        assert sorted(n[doc == i].tolist()) == sorted(want.values())


def test_odd_rows(docs, nothing):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert langid.identify(docs).count() == docs.count()
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(nothing).count() == 0


def ranked(counts):
    code = lambda g: tuple(ord(c) for c in g)
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.PROFILE]


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return Counter(g for w in words for g in [*w, *(f" {w} "[k : k + 2] for k in range(len(w) + 1)), *(f" {w} "[k : k + 3] for k in range(len(w)))])


def test_distances_match_a_plain_computation(spark, docs):
    """Every document's language and score from profiles and out-of-place distances computed with dictionaries."""
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(10**6 + r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    totals = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            totals.setdefault(lang, Counter()).update(plain_grams(text))
    place = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in totals.items()}
    want = []
    for i, text, _ in rows:
        own = ranked(plain_grams(text))
        far = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(far), key=far.get)
        want.append((i, best, round(1 - far[best] / (langid.PROFILE * len(own)), 9)) if own else (i, "und", 0.0))
    assert len(place) > 3
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(df).collect()) == sorted(want)


def test_slices_with_nearly_all_letters():
    every = "".join(chr(c) for c in range(0x110000) if chr(c).isalpha() and len(chr(c).lower()) == 1)
    texts = [every, "ab", *["c"] * 2000, every]
    doc, gram, n = langid.grams(texts)
    for i in (0, 1, 1000, len(texts) - 1):
        assert n[doc == i].sum() == sum(plain_grams(texts[i]).values()) and len(gram[doc == i]) == len(plain_grams(texts[i]))
