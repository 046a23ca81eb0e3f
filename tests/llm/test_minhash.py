import random

import numpy as np
import pytest

from fleetgrid.llm import alike, minhash


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; ids tell rows apart."""
    sets = {i: {*alike.shingles(t or "", 4).tolist()} for i, t in rows}
    label = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        before = dict(label)
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
        changed = before != label
    return sorted((i, len(s), label[i], i == label[i]) for i, s in sets.items())


def found(df):
    return sorted(map(tuple, minhash.near_duplicates(df).collect()))


def test_matches_comparing_all_pairs(spark, small):
    want = brute([(r["doc_id"], r["text"]) for r in small.collect()])
    assert found(small) == want and len({r[2] for r in want}) < len(want)


def test_odd_rows(spark, docs, nothing):
    one = " ".join(f"a{i}" for i in range(60))
    more = [(20, one), (None, one + " end"), (None, "nobody else says this at all"), (None, ""), (21, "ONE Two"), (22, one.replace("a5 ", "b ")), (22, "another text under the same id here")]
    df = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0, "", "", 1) for i, t in more], docs.schema))
    got = sorted(map(tuple, minhash.near_duplicates(df.withColumn("label", df["size"]).withColumn("n", df["kept"])).collect()), key=str)
    assert len(got) == df.count() and minhash.near_duplicates(nothing).count() == 0
    of = {}
    for i, n, c, k in got:
        of.setdefault(i, []).append((n, c, k))
    assert of[1] == [(6, 1, True)] and of[2] == of[11] == [(6, 1, False)]
    assert of[3] == [(0, 3, True)] and of[4] == [(0, 4, True)] and of[5] == [(0, 5, True)]
    assert of[6] == 2 * [(3, 6, True)] and of[7] == [(1, 7, True)] and of[9] == [(1, 9, True)] and of[21] == [(1, 9, False)]
    assert sorted(of[None], key=str) == sorted([(58, 20, False), (3, None, False), (0, None, False)], key=str)
    assert sorted(of[22]) == [(4, 22, True), (57, 20, False)]


@pytest.mark.parametrize("part", [1024, 16])
def test_chains_and_near_misses_in_lists_of_any_size(spark, monkeypatch, part):
    """Copies of copies, alike by way of others only, and texts that share a core and aren't alike."""
    monkeypatch.setattr(alike, "PART", part)
    rng, texts = random.Random(9), []
    for _ in range(3):
        chain = [[f"w{rng.randrange(10**6)}" for _ in range(120)]]
        for _ in range(50):
            words = list(rng.choice(chain))
            for at in rng.sample(range(120), 3):
                words[at] = f"x{rng.randrange(10**6)}"
            chain.append(words)
        texts += [" ".join(w) for w in chain]
    core = " ".join(f"c{i}" for i in range(104))
    texts += [core + "".join(f" y{k}_{i}" for i in range(14)) for k in range(60)]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_pairs_at_the_threshold_are_found(spark):
    rng, rows = random.Random(2), []
    for k in range(600):
        n = rng.randrange(9, 300, 9)
        shared = 8 * n // 9 - (k % 2)  # 8 n / 9 shared of n each: 0.8 exactly, or just below
        words = [f"w{rng.randrange(10**9)}" for _ in range(2 * n - shared + 3)]
        rows += [(2 * k, " ".join(words[: n + 3])), (2 * k + 1, " ".join(words[n - shared :]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(c == (i - i % 2 if i // 2 % 2 == 0 else i) for i, _, c, _ in got)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    hit = []
    for _ in range(300):
        members = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        x, y = (np.frombuffer(minhash.signature(np.sort(m)), np.uint8).reshape(4, -1) for m in (members[:160], members[20:]))
        hit.append((x == y).all(axis=0).sum())
    assert abs(np.mean(hit) / minhash.COORDINATES - 140 / 180) < 0.02 and min(hit) >= minhash.MATCHES
