"""Text, time and subtitle rules."""

import pytest
from helpers import value
from pyspark.sql import functions as F

from lectern.functions import text as x
from lectern.operators import documents
from lectern.sources import files, subtitles


def test_clean_brackets(spark):
    out = value(spark, x.clean_transcript(F.lit("第三讲[咳嗽]，矩阵的秩（铃声）")))
    assert out == "第三讲,矩阵的秩"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("行列式，特征值。下课！", "行列式,特征值.\n下课!"),
        ("a\na\nb\n\nb", "a\nb"),
        ("a\nb\na", "a\nb\na"),
        ("pi is 3.14", "pi is 3.\n14"),
        ("wait... now", "wait.\n.\n.\nnow"),
        ("x   y　　z", "x y z"),
        ("[open (mixed] end", "end"),
        ("[two\nlines]", "[two\nlines]"),
        ("", ""),
        (None, ""),
        ("say \"hi\" 'there'", "say \"hi\" 'there'"),
    ],
)
def test_clean(spark, raw, want):
    assert value(spark, x.clean_transcript(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "seconds,want",
    [(1.5, "00:00:01,500"), (61.25, "00:01:01,250"), (3661.999, "01:01:01,999"), (0.0005, "00:00:00,000"), (0.0015, "00:00:00,002"), (360000.0, "100:00:00,000")],
)
def test_srt_time(spark, seconds, want):
    assert value(spark, x.srt_time(F.lit(seconds))) == want


def test_srt_time_below_zero(spark):
    assert value(spark, x.srt_time(F.lit(-1.5))) == "00:00:00,000"
    assert value(spark, x.srt_time(F.lit(-1.5), clamp=False)) == "-1:59:58,500"


@pytest.mark.parametrize(
    "stamp,want", [("01:02:03,500", 3723.5), ("00:01.250", 1.25), ("1:00:00.001", 3600.001)]
)
def test_parse_time(spark, stamp, want):
    assert value(spark, x.parse_time(F.lit(stamp))) == want


def test_hms(spark):
    assert [value(spark, x.hms(F.lit(s).cast("double"))) for s in (3661.9, -3.0, None)] == ["01:01:01", "00:00:00", "00:00:00"]


@pytest.mark.parametrize(
    "path,want",
    [
        ("frame_00h02m05s125ms_scene_007.jpg", 125.125), ("src/frame_01h00m00s999ms_interval_001.jpg", 3600.999),
        ("frame_00h04m12s.jpg", 0.0), ("a1_53.500.jpg", 0.0), ("frame_00h00m05sms.jpg", 5.0),
    ],
)
def test_frame_name_time(spark, path, want):
    assert value(spark, x.frame_name_time(F.lit(path))) == want


@pytest.mark.parametrize("seconds", [125.125, 3599.999, 0.0, 1.001, 7322.5])
def test_frame_names_round_trip(spark, seconds):
    name = x.frame_name(F.lit(seconds), F.lit("scene"), F.lit(3))
    assert value(spark, x.frame_name_time(name)) == seconds


def test_frame_name_can_print_a_thousand(spark):
    assert value(spark, x.frame_name(F.lit(1.9996), F.lit("scene"), F.lit(1))) == "frame_00h00m01s1000ms_scene_001.jpg"


@pytest.mark.parametrize("seconds", [0.25, 0.35, 53.45, 53.65, 53.0, 633.85, 0.05, 0.15, 1e6 + 0.95, 9.95, 2.675])
def test_one_decimal(spark, seconds):
    assert value(spark, x.one_decimal(F.lit(seconds))) == f"{seconds:.1f}"


SRT = "1\n00:00:01,000 --> 00:00:04,250\n向量空间\n\n2\n00:00:04,250 --> 00:00:09,500\n基与维数 demo\n"


def test_subtitle_srt(table):
    segs = subtitles.subtitle_segments(table("video_id int, path string, text string", (1, "a.srt", SRT), (2, "a.txt", SRT)))
    assert [tuple(r)[2:] for r in segs.orderBy("seq").collect()] == [("向量空间", 1.0, 4.25), ("基与维数 demo", 4.25, 9.5)]


def test_cue_rules(spark):
    text = (
        "WEBVTT\n\n00:09.000 --> 00:10.000 align:start\nlast\n\nid\n00:00:01.000 --> 00:00:02.000\none\n 77 \n two \n\n"
        "00:00:06,000 --> 00:07.000\nmixed forms\n\n00:03.000 --> 00:03.000\nno length\n\n00:04.000 --> 00:05.000\n12\n\nno time here\n \n\n00:00:01,000 --> 00:00:01,500\nshorter"
    )
    got = value(spark, subtitles.cues(F.lit(text)))
    assert [(c.start, c.end, c.text) for c in got] == [(1.0, 1.5, "shorter"), (1.0, 2.0, "one two"), (9.0, 10.0, "last")]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "7.srt").write_text(SRT, encoding="utf-8")
    (tmp_path / "8.txt").write_text("just text", encoding="utf-8")
    read = subtitles.read_subtitle_files(spark, str(tmp_path))
    named = read.withColumn("video_id", F.regexp_extract("path", r"(\d+)\.\w+$", 1))
    got = {r.video_id: r.text for r in subtitles.subtitle_full_text(named).collect()}
    assert got == {"7": "向量空间\n基与维数 demo", "8": "just text"}


def test_frame_folder(spark, tmp_path):
    (tmp_path / "frame_00h00m05s000ms_scene_001.jpg").write_bytes(b"abc")
    (tmp_path / "note.txt").write_text("x")
    frames = files.scan_frames(spark, str(tmp_path))
    assert [(r.size, r.timestamp_sec) for r in frames.collect()] == [(3, 5.0)]
    assert "content" not in frames.columns
    raw = spark.read.format("binaryFile").load(str(tmp_path / "*.jpg"))
    assert [(r.data, r.mime) for r in files.encode_images(raw).collect()] == [("YWJj", "image/jpeg")]


SEGMENTS = "video_id int, seq long, text string, start double, `end` double"


def test_srt_numbering(table):
    segs = table(SEGMENTS, (1, 1, "a", 0.0, 1.0), (1, 2, " ", 1.0, 2.0), (1, 3, "c", 2.0, None), (1, 4, "d", 3.0, 4.0))
    # Recognised speech keeps gaps in the numbers.
    assert documents.srt_from_results(segs).first()["text"] == (
        "1\n00:00:00,000 --> 00:00:01,000\na\n\n4\n00:00:03,000 --> 00:00:04,000\nd"
    )
    rows = segs.where("end IS NOT NULL")
    assert documents.srt_from_rows(rows).first()["text"] == (
        "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\n\n\n3\n00:00:03,000 --> 00:00:04,000\nd\n"
    )


def test_text_in_parts(spark):
    """Parts of a long text, put together, are the text."""
    segs = spark.range(1000).select(
        F.lit(1).alias("video_id"), F.col("id").alias("seq"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text")
    )
    whole = documents.full_text(segs, " ").collect()
    parts = documents.full_text(segs, " ", part_rows=64, max_rows=100).orderBy("part").collect()
    assert len(whole) == 1 and len(parts) == 16
    assert " ".join(p.text for p in parts) == whole[0].text == " ".join(f"w{i}" for i in range(1000))


def test_document_in_parts(spark):
    """The same for documents: only the last part is trimmed."""
    segs = spark.range(300).select(
        F.lit(1).alias("video_id"), F.col("id").alias("seq"), F.lit(" line ").alias("text"), F.lit(1.0).alias("start"), F.lit(2.0).alias("end")
    )
    whole = documents.srt_from_rows(segs).collect()
    parts = documents.srt_from_rows(segs, part_rows=7).orderBy("part").collect()
    assert len(parts) == 43 and "\n".join(p.text for p in parts) == whole[0].text


def test_written_text_files(spark, table, tmp_path):
    parts = table("video_id int, part int, text string", (1, 0, "# A\n\nbody\n"), (2, 0, "# B\n"))
    files.write_text_files(parts, str(tmp_path / "out"), "srt")
    got = {r.path.split("/")[-1].removesuffix(".srt"): r.text for r in subtitles.read_subtitle_files(spark, str(tmp_path / "out")).collect()}
    assert got == {"1": "# A\n\nbody\n", "2": "# B\n"}


RESULT = '{"transcripts":[{"sentences":[{"text":"hi","begin_time":5000,"end_time":7000},{"text":" "},{"text":"no times"}]},{"sentences":[{"text":"other"}]}]}'


def test_recognition_results(table):
    rows = table("video_id int, index int, start_sec double, result string", (1, 1, 1800.0, RESULT), (1, 2, 0.0, '{"transcripts":[]}'), (1, 3, 0.0, "{"))
    got = subtitles.recognised_segments(rows).orderBy("position").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("hi", 1805.0, 1807.0), ("no times", 1800.0, 1800.0)]


def test_timed_transcript(table):
    body = '{"content":[{"text":">> Hello there","offset":1500,"duration":2200},{"text":">>","offset":1},{"text":"x","offset":0,"duration":50}]}'
    got = subtitles.timed_transcript(table("video_id int, body string", (1, body))).orderBy("position").collect()
    assert [(r.text, r.start, r.end) for r in got] == [("Hello there", 1.5, 3.7), ("x", 0.0, 0.2)]
