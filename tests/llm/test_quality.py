import numpy as np
from pyspark.sql import functions as F

from fleetgrid.llm import quality


def test_held_out_selection(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    share = {(r["quality"], r["toxic"]): r["s"] for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("selected").cast("double")).alias("s")).collect()}
    assert share[1, 0] > 0.97 and share[0, 0] < 0.05 and share[1, 1] < 0.7


def test_ordered_thresholds():
    rng = np.random.default_rng(0)
    n = 600
    grades = rng.integers(0, 3, n)
    buckets = [np.array([g, 10 + int(rng.integers(50))], dtype=np.int32) for g in grades]
    model = quality.fit_model(buckets, [np.ones(2, dtype=np.float32)] * n, grades)
    tails = model.tails(np.array([model.weights[b].sum() for b in buckets]))
    assert model.thresholds[0] < model.thresholds[1] and np.all(tails[:, 0] >= tails[:, 1])
    assert np.mean((tails > 0.5).sum(1) == grades) > 0.99


def test_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (7, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.count() == docs.count() and got.filter("p_above_1 > p_above_0").count() == 0
    assert quality.keep_selected(docs, labels).columns == docs.columns
    other = docs.withColumnRenamed("text", "body")
    assert quality.keep_selected(other, labels, text_col="body").count() == quality.keep_selected(docs, labels).count()
    assert quality.classify(docs, labels.limit(0)).filter("not selected").count() == 0
    assert quality.classify(nothing, labels).count() == 0 and quality.keep_selected(nothing, labels).count() == 0


def test_reruns_agree(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(quality.classify(docs.repartition(5), labels).collect()) == sorted(quality.classify(docs, labels).collect())


def test_held_out_documents_with_insults_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    insults = "idiot|moron|scum|trash|worthless|pathetic|loser|disgusting|clown|stupid"
    said = docs.select("doc_id", F.regexp_count(F.lower("text"), F.lit(rf"\b({insults})\b")).alias("insults"))
    got = quality.classify(docs, labels).join(labels, "doc_id").join(said, "doc_id").filter("held_out and quality = 1").select("toxic", "insults", "selected").collect()
    toxic = [r["selected"] for r in got if r["toxic"] == 1 and r["insults"] >= 3]
    clean = [r["selected"] for r in got if r["toxic"] == 0]
    assert len(toxic) > 40 and not any(toxic) and sum(clean) > 0.985 * len(clean)


def plain_loss(score, cuts, grades):
    """Mean negative log-likelihood, one text at a time."""
    total = 0.0
    for x, g in zip(score, grades, strict=True):
        upto = [0.0, *(1 / (1 + np.exp(x - c)) for c in cuts), 1.0]
        total -= np.log(upto[g + 1] - upto[g])
    return total / len(score)


def test_loss_and_gradient_match_a_plain_computation():
    rng, step = np.random.default_rng(2), 1e-6
    for cuts in (np.array([0.3]), np.array([-0.5, 0.8]), np.array([-1.0, 0.1, 1.7])):
        score, grades = rng.normal(size=40), rng.integers(0, len(cuts) + 1, 40)
        loss, by_score, by_cut = quality.slopes(score, cuts, grades)
        assert abs(loss - plain_loss(score, cuts, grades)) < 1e-9
        for slope, own, other in ((by_score, score, lambda v: plain_loss(v, cuts, grades)), (by_cut, cuts, lambda v: plain_loss(score, v, grades))):
            for i in range(len(own)):
                up, down = own.copy(), own.copy()
                up[i] += step
                down[i] -= step
                assert abs(slope[i] - (other(up) - other(down)) / (2 * step)) < 1e-6
