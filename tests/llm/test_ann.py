import numpy as np
import pytest

from fleetgrid.llm import ann


def brute(rows, every, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in range(len(rows)):
        if ids[q] % every == 0:
            s = np.zeros(len(x))
            for d in range(x.shape[1]):
                s += x[q, d] * x[:, d]
            order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def found(df, every=20):
    got = {}
    for r in ann.nearest(df, every).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_over_the_table(spark):
    recall_of(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))


def test_recall_over_several_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 9000)] + 0.4 * rng.normal(size=(9000, 32))
    recall_of(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))


def recall_of(df):
    got, want = found(df), brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(s - exact[q, i]) < 1e-15 for q, g in got.items() for i, s in g if (q, i) in exact)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    print(f"recall of the 20 nearest among {df.count()} vectors: {recall:.3f}")
    assert recall >= 0.9


def test_the_least_vector_of_a_repeated_id_asks(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert found(df)[0] == [(2, 2.0), (1, 1.0)]


def test_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).tolist()) for i in range(0, 60)]
    good += [(i, good[0][1]) for i in range(100, 180)]  # copies: ties go to smaller ids
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan")] * 4), (280, [float("inf"), 0.0, 0.0, 0.0]), (300, [1.0] * 3), (320, [])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in good + bad + good[:3]], "vec_id long, embedding array<double>, score double, rank int")
    assert found(df) == brute(good, 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert found(df) == {0: [(3, 0.5), (20, 0.0)], 20: [(3, 0.5), (0, 0.0)]}
    assert ann.nearest(df.limit(0)).count() == 0


def test_encoding_and_distances():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    books = ann.fit(x, books=6, words=32)
    codes, norms = ann.encode(x, books)
    sums = sum(books[b][codes[:, b]] for b in range(6))
    assert np.allclose((sums * sums).sum(1), norms, rtol=1e-3)
    greedy, _ = ann.encode(x, books, beam=1)
    error = lambda c: ((x - sum(books[b][c[:, b]] for b in range(6))) ** 2).sum()
    assert error(codes) <= error(greedy) < 0.7 * (x * x).sum()
    near = ann.candidates(x[:5], codes, books, 40, norms)
    assert all(i in near[i] for i in range(5))


def test_squared_distance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = ann.usable(df, "vec_id", "embedding").filter("vec_id = 7")
    got = [(r["vec_id"], r["score"]) for r in ann.search(df, q, k=5, squared=True).orderBy("rank").collect()]
    far = ((x - x[7]) ** 2).sum(1)
    want = [int(i) for i in np.argsort(far) if i != 7][:5]
    assert [i for i, _ in got] == want and [-s for _, s in got] == pytest.approx(far[want].tolist())


def test_vectors_of_each_length_are_searched(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=(4, 6, 6)[i % 3])]) for i in range(90)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = dict(rows)
    assert set(got) == {i for i in vectors if i % 10 == 0}
    for q, found in got.items():
        others = [(-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in sorted(others)[:20]]
