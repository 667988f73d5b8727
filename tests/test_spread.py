"""Heavy work per row: dealt out evenly, and done once."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern.functions import model_output as mo
from lectern.session import spread


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_one_row_group_in_many_splits(spark, tmp_path):
    """More splits than cores, but all rows begin in one of them."""
    pq.write_table(pa.table({"x": range(40_000)}), tmp_path / "x.parquet", use_dictionary=False, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = spark.read.parquet(str(tmp_path))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and len(sizes(df)) == 1
        assert max(sizes(spread(df))) <= 40_000 / spark.sparkContext.defaultParallelism + 1_000
        assert spread(df).agg(F.sum("x")).first()[0] == sum(range(40_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_even_scans_stay_and_long_ones_are_cut(spark):
    even = spark.range(0, 10_000, 1, 16)
    assert spread(even) is even
    empty = even.where("id < 0")
    assert spread(empty) is empty
    assert len(sizes(spread(even, task_rows=300))) == 34


def test_an_answer_is_parsed_once(spark):
    raw = F.concat(F.lit('{"keep_image": true, "n": '), F.col("id").cast("string"), F.lit("}"))
    df = spark.range(3).select(mo.frame_decision(F.try_parse_json(raw), F.lit("p")).alias("d")).select("d.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
    assert {tuple(r)[:2] for r in df.collect()} == {("p", True)}
