import random

import numpy as np
import pytest
import xxhash

from fleetgrid.llm import alike, simhash


def brute_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """fps: id -> fingerprint; the smallest id that each id reaches."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def compare(df):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in df.collect()}
    label = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in fps}
    return got


def test_matches_brute_force(small):
    got = compare(small)
    assert len({c for _, c in got.values()}) < len(got)


def test_odd_rows(docs, nothing):
    got = compare(docs)
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert {got[i][1] for i in (3, 4, 5)} == {3}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


def test_links_in_buckets_of_any_size(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)}
    fps = dict(enumerate(sorted(fps)))
    monkeypatch.setattr(alike, "PART", 8)
    nodes = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in fps.items()], "rep long, code binary")
    found = simhash.components(simhash.links(nodes))
    got = {i: i for i in fps} | {r["node"]: r["label"] for r in found.collect()}
    assert got == brute_components(fps)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    for words, radius in ((1, 3), (4, 44), (1, 0), (2, 7)):
        fps = rng.integers(0, 256, (300, 8 * words), dtype=np.uint8)
        fps[150:] = fps[:150] ^ (rng.random((150, 8 * words)) < radius / 64 / words).astype(np.uint8)
        sliced = simhash.planes(fps)
        for shift in (1, 63, 64, 65, 150, 299):
            n = len(fps) - shift
            want = [i for i in range(n) if np.bitwise_count(fps[i] ^ fps[i + shift]).sum() <= radius]
            alive = np.packbits(np.arange(320) < n, bitorder="little").view("<u8")
            k, bit = simhash.near(sliced, np.arange(5), np.full(5, shift), alive, radius)
            assert (k * 64 + bit).tolist() == want
        got = sorted((int(i), int(j)) for a, b in simhash._hits(np.arange(300) // 200, fps, radius) for i, j in zip(a, b, strict=True))
        assert got == [(i, j) for i in range(300) for j in range(i + 1, 300) if i // 200 == j // 200 and np.bitwise_count(fps[i] ^ fps[j]).sum() <= radius]


def test_alike_texts_meet_and_others_do_not(spark):
    rng = random.Random(5)
    rows, group = [], {}
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        for c in range(3):
            copy = [w if rng.random() > 0.008 * c else f"x{rng.randrange(5000)}" for w in words]
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scheme=simhash.ALIKE).collect()}
    sets = {i: {*zip(*(t.split()[k:] for k in range(5)))} for i, t in rows}
    pairs = [(i, j) for i, _ in rows for j, _ in rows if i < j and group[i] == group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 40 and sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(group[i] == group[c] for i, c in got.items())


def alike_pair(rng, n, shared):
    """Two texts of n shingles of five words each, of which they share ``shared``: the second goes on after the first's end."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(2 * n - shared + 4)]
    return " ".join(words[: n + 4]), " ".join(words[n - shared :])


def pairs_kept(spark, likeness, count):
    """How many of ``count`` pairs of texts with this likeness keep both."""
    rng, rows = random.Random(likeness), []
    for _ in range(count):
        n = rng.randrange(90, 300, 9)
        rows += [(len(rows) + k, t) for k, t in enumerate(alike_pair(rng, n, round(2 * n * likeness / (1 + likeness))))]
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    return sum(i % 2 for i in kept)


def test_texts_below_the_likeness_stay(spark):
    assert pairs_kept(spark, 0.75, 300) == 300 and pairs_kept(spark, 0.7, 300) == 300


def test_pairs_at_the_likeness_are_found(spark):
    assert pairs_kept(spark, 0.8, 1000) <= 10


def test_keep_first_matches_comparing_all_pairs(small):
    rows = {r["doc_id"]: r["text"] for r in small.collect()}
    sets = {i: {*simhash.shingles(t or "", 5).tolist()} for i, t in rows.items()}
    label = {i: i for i in rows}
    linked = [(i, j) for i in rows for j in rows if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    assert {r["doc_id"] for r in simhash.keep_first(small).collect()} == {*label.values()}


def test_chained_copies_in_split_buckets(spark, monkeypatch):
    """Copies of copies: many are alike by way of others only; buckets over PART rows are dealt out in parts."""
    rng, texts = random.Random(8), []
    for _ in range(3):
        chain = [[f"w{rng.randrange(10**6)}" for _ in range(120)]]
        for _ in range(60):
            words = list(rng.choice(chain))
            for at in rng.sample(range(120), 2):
                words[at] = f"x{rng.randrange(10**6)}"
            chain.append(words)
        texts += [" ".join(w) for w in chain]
    sets = [{*simhash.shingles(t, 5).tolist()} for t in texts]
    label = list(range(len(texts)))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 3 <= len({*label}) < 100
    for part in (1024, 16):
        monkeypatch.setattr(alike, "PART", part)
        assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {*label}


def test_components_match_a_plain_search(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200, i) for i in range(170, 230)]
    label = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in alike.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_keep_first_with_null_and_repeated_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (5, one + " end"), (5, two), (None, one + " more"), (None, "quite different"), (None, two + " more"), (7, "same"), (7, "same")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, one), (5, two), (None, "quite different"), (7, "same")], key=str)


def test_sketches_never_rule_out_alike_sets():
    rng = np.random.default_rng(5)
    for n in (1, 8, 25, 300, 4000):
        members = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        for off in range(0, n + 1, max(1, n // 20)):
            x, y = members[:n], members[off : n + off]
            bits = np.bitwise_count(np.frombuffer(alike.sketch(x), np.uint8) ^ np.frombuffer(alike.sketch(y), np.uint8)).sum()
            assert bits <= 2 * off


def components_of(texts):
    """The first text that each text reaches by links of texts alike to 0.8, and the number of links."""
    sets = [{*simhash.shingles(t, 5).tolist()} for t in texts]
    label = list(range(len(texts)))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    return label, len(linked)


def rows_sent(monkeypatch, name):
    """Counts of the rows of frames that a function of alike.py gives."""
    counts, of = [], getattr(alike, name)

    def counted(*args):
        out = alike.durable(of(*args))
        counts.append(out.count())
        return out

    monkeypatch.setattr(alike, name, counted)
    return counts


@pytest.mark.parametrize(("words", "own", "many"), [(30, 1, 240), (118, 14, 400), (118, 14, 800), (1500, 200, 200), (1500, 200, 400)])
def test_near_but_not_alike_texts_send_no_pairs(spark, monkeypatch, words, own, many):
    """Texts that share a core and have a tail of their own: nearly all pairs are candidates, few or none are alike."""
    core = [f"w{i}" for i in range(words - own)]
    texts = [" ".join([*core[: k % 20 + 4], f"x{k}", *core[k % 20 + 5 :]] if own == 1 else [*core, *(f"x{k}_{i}" for i in range(own))]) for k in range(many)]
    label, links = components_of(texts)
    forest, links_sent = rows_sent(monkeypatch, "open_forest"), rows_sent(monkeypatch, "settle")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {*label}
    assert sum(links_sent) < many and sum(forest) <= many * len(simhash.ALIKE.tables)
    assert links < 0.2 * many * many


def test_settled_joins_what_is_alike():
    rng = np.random.default_rng(6)
    for n, many in ((5, 60), (70, 80), (900, 50)):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        sets = [np.unique(np.r_[base[: rng.integers(n // 2, n + 1)], rng.integers(0, 1 << 63, rng.integers(0, n // 2 + 1), dtype=np.uint64)]) for _ in range(many)]
        label, mark = rng.integers(0, many // 2, many), rng.integers(0, 3, many)
        for mark in (np.zeros(many, dtype=int), mark):
            want, got = list(label), list(label)
            pairs = [(i, j) for i in range(many) for j in range(i) if alike.are_alike(sets[i], sets[j]) and (mark[i] != mark[j] or mark[i] == 0)]
            for of, links in ((want, pairs), (got, alike.settled(sets, label, mark))):
                for i, j in links:
                    of[:] = [of[i] if x == of[j] else x for x in of]
            assert len({*zip(want, got)}) == len({*want}) == len({*got})
            assert all(alike.are_alike(sets[i], sets[j]) for i, j in alike.settled(sets, label, mark))
