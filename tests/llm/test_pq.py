import math

import numpy as np
import pytest

from fleetgrid.llm import pq


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_search_finds_what_a_look_at_every_entry_finds(dim):
    rng = np.random.default_rng(dim)
    for spread in (1, 4, 500):  # a small spread makes many ties and repeated entries
        book, x = rng.integers(-spread, spread + 1, (256, dim)), rng.integers(-spread, spread + 1, (3000, dim))
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        code, best = pq.equal_average(x, book)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def plain(rows):
    """Codes, errors and digest by loops over vectors of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in v] for _, v in rows]
    at = pq.edges(len(ints[0]))
    books = [[v[a:b] for v in ints[:256]] for a, b in zip(at, at[1:])]

    def nearest(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p, (a, b) in enumerate(zip(at, at[1:])):
            groups = {}
            for v in ints:
                groups.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for (key, _), v in zip(rows, ints):
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(at, at[1:]))]
        out.append((key, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, pq.digest([np.array(b) for b in books])


def test_codes_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(0, 0.01, 6)]) for i in range(300)]
    good += [(7, good[3][1]), (None, good[4][1]), (12, good[12][1])]
    odd = [(900, None), (901, [0.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] * 6)]
    large, other, empty = (904, [1e12] * 6), (905, [0.5] * 5), (906, [])
    rows = [(i, v, None if i is None or i % 3 == 0 else i % 2, "x", 0) for i, v in [*good, *odd, large, other, empty]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    got = [tuple(r) for r in pq.compress(df).collect()]
    want, digest = plain(good)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted([r[:3] for r in got if r[0] is None or r[0] < 900], key=key) == sorted(want, key=key)
    assert {r[4] for r in got if r[0] is None or r[0] < 900} == {digest}
    by_id = {r[0]: r for r in got}
    assert by_id[904][1:3] == (None, None) and by_id[904][4] is None
    assert by_id[905][1:3] == ("00000000", 0) == by_id[906][1:3] and not {900, 901, 902, 903} & by_id.keys()
    for label in (None, 0, 1):
        own = [r for r in got if (None if r[0] is None or r[0] % 3 == 0 else r[0] % 2) == label]
        assert {r[3] for r in own} == {sum(r[2] or 0 for r in own)}
    assert pq.compress(df.limit(0)).count() == 0
