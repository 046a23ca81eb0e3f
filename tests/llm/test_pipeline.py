import re

import corpus_pipeline as p

from fleetgrid.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({} for _ in range(2))
        for r in docs.collect():
            before[r["doc_id"]] = r
        if name != "byte_bpe":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r for r in out.collect()}
            assert after.keys() <= before.keys()
        if name == "quality":
            good = {r["doc_id"] for r in quality.classify(docs, labels).filter("selected").collect()}
            assert set(after) == good and len(good) > 0.6 * len(before)
        if name == "exact_dedup":
            best = {}
            for i, r in before.items():
                key = re.sub(r"\s", "", r["text"] or "")
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(r["text"] or ""), i))
            assert set(after) == {i for _, i in best.values()}
        if name == "simhash":
            fps = {i: int.from_bytes(simhash.fingerprint(r["text"] or "", simhash.ALIKE), "big") for i, r in before.items()}
            for i in before.keys() - after.keys():
                assert any((fps[i] ^ fps[j]).bit_count() <= simhash.ALIKE.radius for j in before if j != i)
        if name == "mixing":
            assert out.count() >= len(after) and all(re.sub(r"\s", "", r["text"])[:20] in re.sub(r"\s", "", before[i]["text"]) for i, r in after.items())
        if name == "byte_bpe":
            assert out.count() == docs.count()
        docs = out
    assert p.run(spark, SF).count() == docs.count()


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert entry.oracle_sql().keys() <= names.keys()
