"""The pipeline, and the registration of the corpus operators."""

import random
import re

import plain
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontam, mixing, near, pii, quality

rng = random.Random(59)
COMMON = quality.COMMON["en"].split()


def prose(n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else plain.sentence(rng, 1) for _ in range(n))


def test_stages_equal_plain_steps(spark, docs, saved):
    item = plain.sentence(rng, 14)
    clean = [prose(120) for _ in range(30)]
    texts = [
        *clean, clean[0], clean[1] + " end", f"{prose(60)} {item} {prose(60)}", f"{prose(80)} me@x.example.org {prose(20)}",
        prose(10), None, "", "the " * 200, "".join(f"{w}### " for w in clean[2].split()),
    ]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    path = saved(documents=docs(*rows), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    table = spark.read.parquet(f"{path}/documents.parquet")
    left = set(range(len(texts)))
    gone = {
        "quality_rules": {34, 35, 36, 37, 38}, "near_duplicates": {30, 31}, "decontamination": {32}, "personal_data": set(),
    }
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = table
        stage(spark, table, path).write.parquet(f"{path}/out{number}")
        table = spark.read.parquet(f"{path}/out{number}")
        if name != "source_mix":
            assert table.columns == before.columns
            left -= gone[name]
            assert {r["doc_id"] for r in table.collect()} == left, name
    kept = {r["doc_id"]: r for r in before.collect()}
    assert "[EMAIL]" in kept[33]["text"] and "me@x" not in kept[33]["text"]
    assert all(kept[i]["text"] == texts[i] for i in left - {33})
    copies = {r["doc_id"]: r["n"] for r in table.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.plan(before).collect() if r["copies"]}
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, table.collect()))


def test_stages_take_empty_tables(spark, docs, saved):
    path = saved(documents=docs().limit(0), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0
    odd = docs((None, None, None, None, None), (None, prose(60), None, None, None)).withColumns(
        {"kept": F.lit(1), "copies": F.lit(2), "pii": F.lit(3)}
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, path)
        assert got.columns == odd.columns and got.where("kept <> 1 OR copies <> 2 OR pii <> 3").count() == 0


def test_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if re.match(rf"op{n}_", q)]) == 1
    assert "pipeline" in names and {"op2_warc_segments", "op4_systematic_mix"} <= set(entry.oracle_sql())


def test_oracles(spark):
    import os

    import oracle_check

    from lectern.llm import queries

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    con = oracle_check.duck(sf)
    for name, sql in queries.ORACLES.items():
        assert oracle_check.compare(spark, con, sf, name, queries.QUERIES[name], sql) is None


def test_production_shapes():
    assert near.Settings().shingle == 5 and near.Settings().percent == 80
    assert pii.Disclosure().support > 0 and 0 < decontam.Settings().budget < 0.2
