import zlib
from collections import defaultdict

import pytest

from fleetgrid.llm import sharding


def check(df):
    got = sharding.shard(df).collect()
    rows = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == rows
    slots, load = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, [load[s] for s in range(16)]


def test_odd_rows_and_small_table(docs, small, nothing):
    check(docs)
    got, load = check(small)
    largest = max(r["size"] for r in got)
    assert max(load) <= sum(load) / 16 + largest
    assert sharding.shard(nothing).count() == 0


def test_large_group_of_copies_is_subdivided(spark):
    rows = [(i, "copy " * 40 if i % 3 == 0 else f"text {i} " * (1 + i % 60)) for i in range(6000)]
    got, load = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(load) - min(load) <= 0.06 * sum(load) / 16
    small = defaultdict(set)
    for r in got:
        small[r["text_crc32"]].add(r["shard"])
    assert sorted(map(len, small.values()))[-2] == 1  # all other groups of equal texts stay together


def test_null_and_repeated_ids_of_one_text(spark):
    """Half of the rows are one text, all of them without an id or with one id: shards are as even as with ids of their own."""
    for own in (None, 7):
        rows = [(own if i % 2 else i, "copy of one text here" if i % 2 else f"text {i} of its own") for i in range(4000)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got, load = check(df)
        assert max(load) - min(load) <= 4 * sum(load) / 1024
        again = sharding.shard(df.repartition(7)).collect()
        assert sorted(got, key=str) == sorted(again, key=str)


def test_middling_groups_of_copies_stay_together(spark):
    """A group of up to twice a range's share is in one shard, also where its range is overfull."""
    rows = [(i, f"group {i // 8} " * 3 if i < 4000 else f"text {i} ") for i in range(6000)]
    got, load = check(spark.createDataFrame(rows, "doc_id long, text string"))
    of = defaultdict(list)
    for r in got:
        of[r["text_crc32"]].append(r)
    share, n = sum(load) / 1024, len(rows) / 1024
    small = [g for g in of.values() if sum(r["size"] for r in g) <= 2 * share and len(g) <= 2 * n]
    assert len(small) > 2000 and all(len({r["shard"] for r in g}) == 1 for g in small)


def test_many_copies_are_laid_out_by_many_tasks(spark, monkeypatch):
    from fleetgrid.llm import common

    monkeypatch.setattr(common, "COPIES", 64)
    df = spark.createDataFrame([(None if i % 3 else i, "same" if i % 3 else f"t {i}") for i in range(3000)], "doc_id long, text string")
    check(df)


def test_reruns_agree(small):
    assert sorted(sharding.shard(small.repartition(5)).collect(), key=str) == sorted(sharding.shard(small).collect(), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 50, 1023])
def test_range_lookup(spark, n):
    bounds = sorted({(i * 7919) % 5000 for i in range(n)})
    df = spark.range(0, 5000, 13).select(sharding.F.col("id").alias("key")).withColumn("r", sharding._range_of(bounds))
    assert all(r["r"] == sum(b < r["key"] for b in bounds) for r in df.collect())
