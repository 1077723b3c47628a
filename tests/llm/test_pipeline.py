"""The stages of the corpus pipeline on odd rows, and near-duplicates taken out where they lie."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargolens.llm import quality, simhash

SF = "/root/testdata/sf0.001"
EXTRA = ("_file", "_at", "_fp", "_row", "file", "fp", "id", "part", "k1", "rows", "hash", "spans", "kept", "start", "start_", "source_share")


def with_odd_rows(spark):
    """Given documents, copies of some, nulls in any column, empty and long texts, extra columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = docs.select("doc_id", "text", "lang", "source", "n_chars").schema
    some = [r["text"] for r in docs.orderBy("doc_id").limit(30).collect()]
    rng = random.Random(3)
    rows = [(10_000 + k, t, "en", "copy", 1) for k, t in enumerate(some)] + [(10_000, some[0], "en", "copy", 1)] * 2
    rows += [(None, some[1], None, None, None), (20_001, None, "en", "s", 0), (20_002, "", None, "s", None), (20_003, " \n", "en", None, 3)]
    rows += [(20_004, " ".join(f"w{rng.randint(0, 30_000)}" for _ in range(60_000)), "en", "long", 1)]
    odd = spark.createDataFrame(rows, kinds)
    return docs.select(*kinds.names).union(odd).withColumns({c: F.lit("x") for c in EXTRA})


def test_stages(spark, tmp_path):
    docs = with_odd_rows(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = {r["doc_id"]: r["text"] for r in rows.collect()}

    stages = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.stored(stages["quality rules"](spark, rows, str(tmp_path)), "t")
    kept = [(r["doc_id"], r["text"]) for r in good.collect()]
    passing = [(r["doc_id"], r["text"]) for r in rows.collect() if all(rule.passes(quality.Text(r["text"])) for rule in quality.RULES)]
    assert sorted(map(str, kept)) == sorted(map(str, passing))

    single = corpus_pipeline.stored(stages["simhash near-dedup"](spark, good, str(tmp_path)), "t")
    prints = [simhash.fingerprint(t, 4) for _, t in kept]
    groups = list(range(len(kept)))

    def root(a):
        while groups[a] != a:
            a = groups[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                groups[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(kept):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(least.values()))
    assert all(r["text"] == plain[r["doc_id"]] for r in single.collect())

    cut = corpus_pipeline.stored(stages["suffix-array dedup"](spark, single, str(tmp_path)), "t")
    assert sorted(r["doc_id"] for r in cut.collect()) == sorted(r["doc_id"] for r in single.collect())
    clean = stages["benchmark decontamination"](spark, cut, str(tmp_path))
    for frame in (good, single, cut, clean):
        assert frame.columns == rows.columns
        assert frame.schema["n_chars"].dataType == rows.schema["n_chars"].dataType
    left = {r["doc_id"] for r in clean.collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == left
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048


def test_empty_tables(spark, tmp_path):
    with_odd_rows(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("from_files", [True, False])
def test_near_duplicates_stay_where_they_are(spark, tmp_path, from_files):
    """No text passes a shuffle, whether the rows come from files or are computed."""
    docs = with_odd_rows(spark)
    if from_files:
        docs.repartition(3).write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    left = simhash.one_of_each(docs, in_place=from_files)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert left.columns == docs.columns
    found = [r["doc_id"] for r in left.collect()]
    components = simhash.near_duplicates(docs).where("doc_id IS NOT NULL").select("component_id").distinct().collect()
    assert sorted(found) == sorted(r[0] for r in components)
