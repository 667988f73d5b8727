"""Choosing one of several candidates, batches, and free file names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.links import file_language, language
from lectern.operators.ordering import ordered, ordinal, running_sum
from lectern.operators.streams import fold

# Suffixes and source names, best first.
EXISTING_SUFFIXES = ["mp4", "mkv", "webm", "mov", "flv"]
DOWNLOAD_SUFFIXES = ["mp4", "mkv", "webm", "mov", "flv", "m4v"]
SUBTITLE_SUFFIXES = ["srt", "vtt"]
SUBTITLE_SOURCES = ["explicit", "online", "local", "recognised", "synthesised"]


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))


def _rank(value: Column, names: list[str]) -> Column:
    """0-based place of ``value`` in ``names``; their count when absent."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(F.coalesce(at, F.lit(0)) == 0, len(names)).otherwise(at - 1)


def _best(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The row with the least ``by`` per key, as a combining aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("row")).select(*keys, "row.*")


def downloaded_file(files: DataFrame) -> DataFrame:
    """The usable file per video: known suffixes in order, else the newest video file.

    ``files`` is (video_id, name, size, mtime) of files called ``<video_id>.*``.
    """
    exact = F.concat(F.col("video_id").cast("string"), F.lit("."), _suffix(F.col("name"))) == F.col("name")
    first = F.when(exact, _rank(_suffix(F.col("name")), EXISTING_SUFFIXES)).otherwise(len(EXISTING_SUFFIXES))
    usable = files.where((F.col("size") > 0) & _suffix(F.col("name")).isin(DOWNLOAD_SUFFIXES))
    return _best(usable, ["video_id"], F.struct(first, -F.col("mtime"), "name"))


def local_subtitle(files: DataFrame, preferred: list[str]) -> DataFrame:
    """Best subtitle file per video: language, then srt before vtt, then newest."""
    usable = files.where((F.col("size") > 0) & _suffix(F.col("name")).isin(SUBTITLE_SUFFIXES)).withColumn(
        "language", file_language(F.col("name"), F.col("video_id").cast("string"))
    )
    order = F.struct(
        _rank(F.col("language"), preferred),
        _rank(_suffix(F.col("name")), SUBTITLE_SUFFIXES),
        -F.col("mtime"),
        "name",
    )
    return _best(usable, ["video_id"], order)


def pick_track(options: DataFrame) -> DataFrame:
    """First Chinese track, else first English one, else the first."""
    kind = language(F.coalesce(F.nullif("lan", F.lit("")), F.col("id")))
    return _best(options, ["video_id"], F.struct(_rank(kind, ["zh", "en"]), "position"))


def subtitle_source(candidates: DataFrame) -> DataFrame:
    """The subtitle source to use per video: explicit, online, local, recognised, synthesised."""
    return _best(candidates, ["video_id"], F.struct(_rank(F.col("source"), SUBTITLE_SOURCES), "path"))


def newest(files: DataFrame) -> DataFrame:
    """The newest non-empty file per video."""
    return _best(files.where("size > 0"), ["video_id"], F.struct(-F.col("mtime"), "name"))


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int, **options) -> DataFrame:
    """Rows numbered into batches of ``size``, in order."""
    return ordered(rows, keys, order, {"__pos": ordinal()}, **options).select(
        *rows.columns, F.floor((F.col("__pos") - 1) / size).cast("int").alias("batch")
    )


_STEM = r"\A(.+?)(\.[^.]*)?\z"
# A made-up name ends in a number from 2 on; more digits than this no row ever reaches.
_NUMBERED = r"\A(.+?)((?:_(?:[2-9]|[1-9][0-9]{1,17}))*)\z"


class _Family:
    """Names of one root (``a``, ``a_2``, ``a_2_3``, ``a_3``) in the order of their numbers.

    A name can be wanted by its own rows, as their first choice, and by the rows of the name
    it was made from, as their choice number k. Whoever comes first has it: the stack holds
    the names on the way to the current one, with what they have lost so far.
    """

    def __init__(self) -> None:
        self.stack: list[list] = []  # path, name, rows, numbers lost

    def take(self, path, name, n_rows, present, before) -> Iterator[tuple]:
        while self.stack and path[: len(self.stack[-1][0])] != self.stack[-1][0]:
            self.stack.pop()
        gone = present
        if path and self.stack and self.stack[-1][0] == path[:-1]:
            parent = self.stack[-1]
            reached = path[-1] - parent[3]  # the row of the parent that comes to this number
            if reached > before:
                parent[3] += 1
                if reached <= parent[2]:
                    yield parent[1], reached
            else:
                gone = True
        self.stack.append([path, name, n_rows, int(gone)])
        if gone and n_rows:
            yield name, 1

    def end(self) -> None:
        return None


def unique_names(rows: DataFrame, order: list[str], existing: DataFrame | None = None, **options) -> DataFrame:
    """Collision-free ``target`` per folder: the row's ``name``, else ``stem_2.ext``, ``stem_3.ext``, ...

    Rows take names in ``order``, each the first free one of its list; ``existing`` has the
    (folder, name) of files that are already there. Copies of one name take numbers by
    their rank, moved up by the numbers that are lost to existing files and to rows whose own
    name is such a number. Which are lost follows from one pass over the distinct names,
    so there is one row per name in it and no round per conflict. A null name has no target.
    """
    name = F.col("name").cast("string")
    rows = ordered(rows, ["folder"], order, {"__seq": ordinal()}, **options)
    rows = ordered(rows, ["folder", "name"], ["__seq"], {"__rank": ordinal()}, **options)
    names = rows.where("name IS NOT NULL").groupBy("folder", "name").agg(
        F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"), F.lit(False).alias("__present")
    )
    if existing is not None:
        there = existing.select(
            "folder", "name", F.lit(0).cast("long").alias("__first"), F.lit(0).cast("long").alias("__n"),
            F.lit(True).alias("__present"),
        )
        names = names.unionByName(there).groupBy("folder", "name").agg(
            F.min("__first").alias("__first"), F.sum("__n").alias("__n"), F.max("__present").alias("__present")
        )
    stem, ext = F.regexp_extract(name, _STEM, 1), F.regexp_extract(name, _STEM, 2)
    root, numbers = F.regexp_extract(stem, _NUMBERED, 1), F.regexp_extract(stem, _NUMBERED, 2)
    path = F.when(numbers == "", F.array().cast("array<bigint>")).otherwise(
        F.split(F.substr(numbers, F.lit(2)), "_").cast("array<bigint>")
    )
    names = names.select(
        "folder", root.alias("__root"), ext.alias("__ext"), path.alias("__path"), "name", "__n", "__present", "__first",
        F.concat(root, F.regexp_replace(numbers, r"_[0-9]+\z", ""), ext).alias("__parent"),
    )
    # How many rows of the name it was made from come before a name's own first row.
    numbered = names.where(F.size("__path") > 0)
    probes = numbered.select(
        "folder", F.col("__parent").alias("name"), F.col("__first").alias("__seq"), F.lit(0).alias("__own"),
        F.struct(*[c for c in names.columns if c != "folder"]).alias("__probe"),
    )
    taken = rows.select("folder", "name", "__seq", F.lit(1).alias("__own"))
    found = ordered(
        taken.unionByName(probes, allowMissingColumns=True), ["folder", "name"], ["__seq", "__own"],
        {"__before": running_sum(F.col("__own"))}, **options,
    ).where("__own = 0").select("folder", "__probe.*", "__before")
    entries = found.unionByName(names.where(F.size("__path") == 0).withColumn("__before", F.lit(0).cast("long")))
    losses = fold(
        entries.select("folder", "__root", "__ext", "__path", "name", "__n", "__present", "__before"),
        ["folder", "__root", "__ext"], ["__path", "name"], _Family, "name string, __rank long",
    ).select("folder", "name", "__rank", F.lit(0).alias("__kind"))
    placed = ordered(
        rows.withColumn("__kind", F.lit(1)).unionByName(losses, allowMissingColumns=True),
        ["folder", "name"], ["__rank", "__kind"], {"__moved": running_sum(1 - F.col("__kind"))}, **options,
    ).where("__kind = 1")
    number = F.col("__rank") + F.col("__moved")
    made = F.concat(stem, F.lit("_"), number.cast("string"), ext)
    return placed.withColumn("target", F.when(number == 1, name).otherwise(made)).drop(
        "__seq", "__rank", "__kind", "__moved"
    )
