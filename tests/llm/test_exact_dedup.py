import hashlib
import re
from collections import defaultdict

import pytest

from fleetgrid.llm import exact_dedup


def brute(rows):
    """Rows (id, text) -> sorted (id, keep, size, kept, digest)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort()
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, members[0][3], len(members), k == 0, sha) for k, (_, _, _, i) in enumerate(members)]
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["docs", "small"])
def test_matches_brute_force(table, request):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(df, digest_all=True).collect()), key=str)
    assert got == brute(rows)
    lean = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert lean == sorted((r[:4] for r in brute(rows)), key=str)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_nulls_and_empty(spark, nothing):
    rows = [(None, "a b"), (2, "ab"), (None, "ab"), (3, None), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in exact_dedup.exact_groups(df, digest_all=True).collect()), key=str) == brute(rows)
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0


def test_null_and_repeated_ids_with_other_texts(spark):
    def kept(*rows):
        return sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    assert kept((1, "longer x"), (None, "longer x"), (None, "other")) == [(1, "longer x"), (None, "other")]
    assert kept((None, "a b"), (None, "ab"), (None, "quite different")) == [(None, "a b"), (None, "quite different")]
    assert kept((1, "a b"), (2, "ab"), (2, "other"), (3, "x y"), (3, "x\ty"), (3, "z"), (3, "z"))[:3] == [(1, "a b"), (2, "other"), *kept((3, "x y"), (3, "x\ty"))]
    assert kept((3, "z"), (3, "z"), (None, "z"), (3, "y"), (None, None), (None, "")) in ([(3, "y"), (3, "z"), (None, t)] for t in (None, ""))
