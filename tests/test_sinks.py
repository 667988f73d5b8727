"""Text files per document."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import files
from lectern.sources.text_sink import file_name


def written(path):
    return [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".srt")]


def test_many_documents_in_few_folders(spark, tmp_path):
    path = str(tmp_path / "srt")
    parts = spark.range(12_000).select(
        (F.col("id") % 10_000).alias("video_id"), (1 - F.floor(F.col("id") / 10_000)).cast("int").alias("part"),
        F.concat(F.lit("é\r\n"), F.col("id").cast("string"), F.lit("\n")).alias("text"),
    )
    files.write_text_files(parts, path, "srt")
    assert len(written(path)) == 10_000 and len(os.listdir(path)) <= 8 + 2
    got = {r.video_id: r.text for r in files.read_text_files(spark, path, "srt").collect()}
    want = {str(i): (f"é\r\n{i + 10_000}\n" if i < 2_000 else "") + f"é\r\n{i}\n" for i in range(10_000)}
    assert got == want


def test_odd_names_nulls_and_overwriting(spark, table, tmp_path):
    path = str(tmp_path / "srt")
    schema = "video_id string, part int, text string"
    names = ["a/b", "..", ".hidden", "_under", "100%", "a b+c", "é中", "", None, "x.srt"]
    rows = [(n, 0, f"text of {n}") for n in names] + [("empty", 0, None)]
    for _ in range(2):
        files.write_text_files(table(schema, *rows), path, "srt")
        got = {r.video_id: r.text for r in files.read_text_files(spark, path, "srt").collect()}
        assert got == {n: f"text of {n}" for n in names} and len(written(path)) == len(rows)
    files.write_text_files(table(schema, ("only", 0, "one")), path, "srt")
    assert [tuple(r) for r in files.read_text_files(spark, path, "srt").collect()] == [("only", "one")]
    files.write_text_files(table(schema), path, "srt")
    assert not written(path) and "_SUCCESS" in os.listdir(path)


def test_a_failed_job_leaves_nothing_new(spark, table, tmp_path):
    path = str(tmp_path / "srt")
    files.write_text_files(table("video_id int, part int, text string", (1, 0, "kept")), path, "srt")
    bad = spark.range(200).select(
        F.col("id").alias("video_id"), F.lit(0).alias("part"),
        F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"),
    )
    with pytest.raises(Exception, match="broken"):
        files.write_text_files(bad, path, "srt")
    assert [tuple(r) for r in files.read_text_files(spark, path, "srt").collect()] == [("1", "kept")]
    assert "_temporary" not in os.listdir(path)


def test_a_task_reads_a_folder_of_documents(spark, tmp_path):
    """Tasks are those that wrote, not one per few files; hidden, other and empty files are no documents."""
    path = tmp_path / "srt"
    parts = spark.range(3_000).select(F.col("id").alias("video_id"), F.lit(0).alias("part"), F.col("id").cast("string").alias("text"))
    files.write_text_files(parts, str(path), "srt")
    for name, text in [("top.srt", "t"), ("in/deep/er.srt", "d"), ("in/.x/no.srt", "n"), ("_no/no.srt", "n"), ("in/no.md", "n"), ("in/no.srt", "")]:
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    got = files.read_text_files(spark, str(path), "srt")
    assert got.rdd.getNumPartitions() <= 8 + 2
    assert sorted(map(tuple, got.collect())) == sorted([("top", "t"), ("er", "d"), *[(str(i), str(i)) for i in range(3_000)]])


def test_names_are_safe():
    assert file_name("a/../b", "md") == "a%2F..%2Fb.md" and file_name(".x", "md") == "%2Ex.md"
