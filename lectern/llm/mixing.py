"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's
target over its size. Within a source the expected copies are summed along the
documents in order of size, one random offset per source is added, and a document is
emitted once for every integer boundary that its stretch of the sum crosses. Walking
in order of size keeps the words taken close to the target.

The running sum needs no task with a whole source: documents are counted per
(source, size class, salt), the counts are summed along the few classes and salts of
a source, and ranks are only taken inside one such bucket.

Defined results: null and empty texts have size 0 and are emitted like the others of
their source, taking no words; a null source is a source of its own, the last one;
ties and repeated rows get ranks in an arbitrary but repeatable order of equals; a
source without words has target 0 and rate 0; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import common

WEIGHTS = (1, 2, 3)
MOST = 3
SALTS = 256

_SOURCE = ["__llm_no_source", "__llm_source"]
_BUCKET = [*_SOURCE, "__llm_class", "__llm_salt"]


def _hex_number(text: Column) -> Column:
    """The first 32 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Add ``size`` (words), and the source, size class and salt of the row."""
    return docs.withColumns(
        {
            "size": common.word_count(common.text_of(docs)),
            "__llm_no_source": F.col("source").isNull(),
            "__llm_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "__llm_salt": _hex_number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % SALTS,
        }
    ).withColumn(
        # The bit length and the three bits after the first: steps of an eighth.
        "__llm_class",
        F.expr("length(bin(size)) * 8L + (shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7L)"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (null last, by code point): ``source_size``, ``target`` and the offset.

    Weights repeat along the sources. Targets share all sizes by weight and stop at
    ``MOST`` times the source; what is over goes to the others by weight. Sorted by
    the level at which they stop, the stopped sources come first, so the level of the
    rest follows from running sums: no rounds. One row per source.
    """
    by_name = Window.orderBy(*_SOURCE)
    by_level = Window.orderBy(F.col("__llm_stop") / F.col("__llm_weight"), *_SOURCE)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    table = sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    table = table.withColumns(
        {
            "__llm_weight": weight.cast("long"),
            "__llm_stop": F.col("source_size") * MOST,
            "__llm_total": F.sum("source_size").over(everything),
        }
    )
    table = table.withColumns(
        {
            "__llm_left": F.col("__llm_total") - F.coalesce(F.sum("__llm_stop").over(before), F.lit(0)),
            "__llm_open": F.sum("__llm_weight").over(everything)
            - F.coalesce(F.sum("__llm_weight").over(before), F.lit(0)),
        }
    )
    # The first source that its share does not fill sets the level of all after it.
    fits = F.col("__llm_left") * F.col("__llm_weight") <= F.col("__llm_stop") * F.col("__llm_open")
    level = F.struct("__llm_left", "__llm_open")
    first = F.first(F.when(fits, level), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    table = table.withColumn("__llm_level", first)
    share = F.col("__llm_level.__llm_left") * F.col("__llm_weight") / F.col("__llm_level.__llm_open")
    stop = F.col("__llm_stop").cast("double")
    target = F.when(F.col("__llm_level").isNull(), stop).otherwise(F.least(share.cast("double"), stop))
    name = F.concat_ws(":", F.lit("mix"), F.col("__llm_no_source").cast("string"), F.col("__llm_source"))
    return table.select(
        *_SOURCE, "source_size", target.alias("target"),
        (_hex_number(name).cast("double") / F.lit(4294967296.0)).alias("__llm_offset"),
    )


def sampled(sizes: DataFrame) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to measured rows (read twice: write them first)."""
    counts = sizes.groupBy(*_BUCKET).agg(F.count("*").alias("__llm_n"))
    along = Window.partitionBy(*_SOURCE).orderBy("__llm_class", "__llm_salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(*_BUCKET, F.coalesce(F.sum("__llm_n").over(along), F.lit(0)).alias("__llm_start"))
    inside = Window.partitionBy(*_BUCKET).orderBy("size", "doc_id")
    ranked = sizes.withColumn("__llm_rank", F.row_number().over(inside))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    df = (
        ranked.join(starts, _BUCKET)
        .join(targets(sizes), _SOURCE)
        .withColumns({"__llm_rate": rate, "__llm_rank": F.col("__llm_start") + F.col("__llm_rank")})
    )

    def crossed(rank: Column) -> Column:
        return F.floor(F.col("__llm_offset") + F.col("__llm_rate") * rank)

    copies = crossed(F.col("__llm_rank")) - crossed(F.col("__llm_rank") - 1)
    # Rounding of the products must not add a boundary.
    copies = F.least(copies, F.ceil("__llm_rate")).cast("long")
    return df.withColumn("copies", copies).drop("__llm_start", "__llm_rank", "__llm_rate", "__llm_offset")


def plan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``; texts are read once."""
    sizes = common.stage(measured(docs.select("doc_id", "text", "source")).drop("text"), "mix")
    return sampled(sizes).drop("source", *_BUCKET)


def _numbered(df: DataFrame) -> DataFrame:
    """Number the rows of one id and text, so that repeated rows meet one plan row each."""
    same = Window.partitionBy("__llm_key", "__llm_size").orderBy(F.lit(1))
    return df.withColumn("__llm_number", F.row_number().over(same))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: every row as often as planned, with its ``copy`` number from 1.

    Texts are shuffled once, to meet their plan rows.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), common.text_of(docs), F.col("source").cast("string"))
    keyed = docs.withColumns({"__llm_key": key, "__llm_size": common.word_count(common.text_of(docs))})
    sizes = common.stage(measured(keyed.select("doc_id", "text", "source", "__llm_key")).drop("text", "source"), "mix")
    chosen = _numbered(sampled(sizes).withColumn("__llm_size", F.col("size"))).where("copies > 0").select(
        "__llm_key", "__llm_size", "__llm_number", F.col("copies").alias("__llm_copies")
    )
    return (
        _numbered(keyed)
        .join(chosen, ["__llm_key", "__llm_size", "__llm_number"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__llm_copies").cast("int"))))
        .select(*[c for c in docs.columns if c != "copy"], "copy")
    )


def op4(spark, sf) -> DataFrame:
    df = plan(common.documents(spark, sf))
    return df.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


_NUMBER = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"

SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_name,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size,
         {_NUMBER.format("coalesce(doc_id::VARCHAR, '')")} % {SALTS} AS salt
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class FROM sized),
totals AS (
  SELECT no_source, source_name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY no_source, source_name) - 1) % 3 + 1 AS weight,
         source_size * {MOST} AS stop, (sum(source_size) OVER ())::BIGINT AS total FROM totals),
levels AS (
  SELECT *, total - coalesce(sum(stop) OVER before, 0)::BIGINT AS remains,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open
  FROM weighted
  WINDOW before AS (ORDER BY stop / weight, no_source, source_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT remains, open FROM levels WHERE remains * weight <= stop * open
  ORDER BY stop / weight, no_source, source_name LIMIT 1),
targets AS (
  SELECT l.no_source, l.source_name, l.source_size,
         CASE WHEN l.stop / l.weight < coalesce(
                (SELECT min(stop / weight) FROM levels WHERE remains * weight <= stop * open), 1e300)
              THEN l.stop::DOUBLE
              ELSE least((SELECT remains FROM level)::DOUBLE * l.weight / (SELECT open FROM level), l.stop::DOUBLE)
         END AS target,
         {_NUMBER.format("'mix:' || l.no_source || ':' || l.source_name")} / 4294967296e0 AS shift
  FROM levels l),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, source_name ORDER BY class, salt, size, doc_id) AS rank
  FROM classed),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM ranked JOIN targets USING (no_source, source_name))
SELECT doc_id, size, source_size, target,
       least(floor(shift + rate * rank) - floor(shift + rate * (rank - 1)), ceil(rate))::BIGINT * size AS taken
FROM rated"""
