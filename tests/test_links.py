"""Links, languages, intents, catalog, choices."""

import random

import pytest
from helpers import value
from pyspark.sql import functions as F

from lectern.functions import intent, links
from lectern.operators import catalog, selection
from lectern.sources import subtitles


@pytest.mark.parametrize(
    "text,want",
    [
        ("3.21 口令 https://v.douyin.com/kQ7_m2/ 去应用里看", "https://v.douyin.com/kQ7_m2/"),
        ("看https://b23.tv/k7Qx，很好", "https://b23.tv/k7Qx"),
        ("(see https://youtu.be/x).", "https://youtu.be/x"),
        ("HTTP://A.example/x", "HTTP://A.example/x"),
        ("nothing", None),
    ],
)
def test_extract_url(spark, text, want):
    assert value(spark, links.extract_url(F.lit(text))) == want


@pytest.mark.parametrize(
    "url,platform,video",
    [
        ("https://www.bilibili.com/video/BV1qW4y1p8z?p=2", "bilibili", "BV1qW4y1p8z"),
        ("https://b23.tv/k7Qx", "bilibili", None),
        ("https://music.youtube.com/watch?v=Lec_ture-01", "youtube", "Lec_ture-01"),
        ("https://youtu.be/Lec_ture-01", "youtube", "Lec_ture-01"),
        ("https://www.douyin.com/video/880042", "douyin", "880042"),
        ("https://www.douyin.com/x?modal_id=77", "douyin", "77"),
        ("https://www.kuaishou.com/short-video/3xq9k", "kuaishou", "3xq9k"),
        ("https://notyoutube.com/watch?v=Lec_ture-01", None, None),
        ("not a url", None, None),
        ("https://user@www.Bilibili.com.:80/video/BV1x[1]|2", "bilibili", "BV1x"),
        ("https://youtube.com.evil.example/x", None, None),
    ],
)
def test_platforms(spark, url, platform, video):
    p = links.platform(F.lit(url))
    assert value(spark, p) == platform
    assert value(spark, links.video_id(F.lit(url), p)) == video


def test_page_and_canonical(spark):
    assert value(spark, links.page_number(F.lit("https://www.bilibili.com/video/BV1?p=3"))) == 3
    assert value(spark, links.page_number(F.lit("https://www.bilibili.com/video/BV1?p="))) == 1
    assert value(spark, links.canonical_douyin(F.lit("https://x/?aweme_id=9"))) == "https://www.douyin.com/video/9"


@pytest.mark.parametrize("raw,want", [("zh-CN", "zh"), ("CN", "zh"), ("English", "en"), (" fr ", "fr"), ("", None), (None, None), ("繁體", "zh")])
def test_language(spark, raw, want):
    assert value(spark, links.language(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("talk.srt", "und"), ("talk.zh-Hans.vtt", "zh"), ("other.srt", "und"), ("talk.FR.srt", "FR")])
def test_file_language(spark, name, want):
    assert value(spark, links.file_language(F.lit(name), F.lit("talk"))) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("run https://x", "run https://x"), ("  help", "  help"), ("总结一下", "summarize"),
        ("总结 https://youtu.be/a。", "run https://youtu.be/a"), ("处理 /tmp/a b.mp4 谢谢", "error: 缺少视频链接或文件路径"),
        ("处理 ~/v/a.mp4", "run ~/v/a.mp4"), ("处理这个视频", "error: 缺少视频链接或文件路径"), ("写一个排序", "ask 写一个排序"),
        ("running late", "ask running late"),
    ],
)
def test_intent(spark, text, want):
    assert value(spark, intent.intent(F.lit(text))) == want


TRACKS = '{"data":{"subtitle":{"subtitles":[{"lan":"en","subtitle_url":"//a/1"},{"lan":"zh-CN","lan_doc":"中文","subtitle_url":"//a/2"},{"lan":"x"}]}}}'


def test_track_choice(table):
    tracks = subtitles.subtitle_tracks(table("video_id int, body string", (1, TRACKS), (2, '{"data":null}')))
    assert tracks.count() == 2
    best = selection.pick_track(tracks).collect()
    assert [(r.video_id, r.id, r.label, r.url) for r in best] == [(1, "zh-CN", "中文", "https://a/2")]


def test_subtitle_bodies(table):
    bodies = table(
        "video_id int, body string",
        (1, '{"body":[{"content":"a","from":1,"to":2},{"content":" "}]}'),
        (2, '{"body":"x","data":{"body":[{"content":"b","from":5,"to":5}]}}'),
        (3, '{"content":[{"content":"c"}]}'),
        (4, "[]"),
    )
    got = subtitles.body_segments(bodies).orderBy("video_id").collect()
    assert [(r.video_id, r.text, r.start, r.end) for r in got] == [(1, "a", 1.0, 2.0), (2, "b", 5.0, 8.0), (3, "c", 0.0, 3.0)]


FILES = "video_id string, name string, size long, mtime long"


def test_local_tracks(table):
    rows = table(FILES, ("talk", "talk.en.srt", 1, 9), ("talk", "talk.zh-Hans.vtt", 1, 9), ("talk", "talk.zh-CN.srt", 1, 1), ("talk", "talk.zh.srt", 0, 1))
    assert selection.local_subtitle(rows, ["zh", "en"]).first()["name"] == "talk.zh-CN.srt"
    assert selection.local_subtitle(rows, ["en", "zh"]).first()["name"] == "talk.en.srt"


def test_downloaded_file(table):
    rows = table(
        FILES, ("a", "a.mkv", 1, 1), ("a", "a.webm", 1, 9), ("b", "b.f1.mp4", 1, 2), ("b", "b.m4v", 1, 3), ("b", "b.mp4", 0, 9), ("c", "c.part", 1, 1)
    )
    assert {r.video_id: r.name for r in selection.downloaded_file(rows).collect()} == {"a": "a.mkv", "b": "b.m4v"}


def taken_in_turn(names, present=()):
    taken, out = set(present), []
    for name in names:
        stem, dot, ext = name.rpartition(".")
        target, i = name, 2
        while target in taken:
            target = f"{stem}_{i}.{ext}" if dot and stem else f"{name}_{i}"
            i += 1
        taken.add(target)
        out.append(target)
    return out


NAMES = [
    ["a.jpg", "a.jpg", "a_2.jpg", "a.jpg", "a_2.jpg", "a_2_2.jpg"],
    ["a_3.jpg", "a_2.jpg", "a.jpg", "a.jpg", "a.jpg", "a.jpg"],
    ["x", "x", "x_2", "x_3", "x", "x_2"],
    ["a.jpg"] * 9 + ["b.jpg"],
    ["a_2.jpg", "a_4.jpg", "a_6.jpg"] + ["a.jpg"] * 8,
]


@pytest.mark.parametrize("max_rows", [1000, 3])
def test_unique_names(table, max_rows):
    rows = [(f"f{k}", i, n) for k, names in enumerate(NAMES) for i, n in enumerate(names)]
    got = selection.unique_names(table("folder string, id int, name string", *rows), ["id"], max_rows=max_rows).collect()
    for k, names in enumerate(NAMES):
        mine = sorted((r.id, r.target) for r in got if r.folder == f"f{k}")
        assert [target for _, target in mine] == taken_in_turn(names)


def test_unique_names_among_conflicts_and_files(table):
    rng = random.Random(5)
    stems = ["a", "a_2", "a_3", "a_2_2", "a_2_3", "a_2_2_2", "a_10", "b", "_2", "a_02", "a_1", "b_2_5"]
    rows, files = [], []
    for k in range(60):
        few = rng.sample(stems, rng.randint(1, 6))
        files += [(f"f{k}", n) for n in {rng.choice(stems) + rng.choice(["", ".jpg"]) for _ in range(rng.randint(0, 5))}]
        rows += [(f"f{k}", i, rng.choice(few) + rng.choice(["", ".jpg"])) for i in range(rng.randint(1, 40))]
    files.append((None, "a"))
    rows += [(None, 1, "a"), (None, 2, None)]
    got = selection.unique_names(
        table("folder string, id int, name string", *rows), ["id"], table("folder string, name string", *files)
    ).collect()
    for folder in {r[0] for r in rows}:
        mine = [r[2] for r in rows if r[0] == folder and r[2]]
        have = {name for at, name in files if at == folder}
        assert [r.target for r in sorted(got, key=lambda r: r.id) if r.folder == folder and r.name] == taken_in_turn(mine, have)
    assert len(got) == len(rows)


def test_catalog(spark, table):
    asked = table(
        "model string, purpose string, max_tokens_asked int",
        ("GPT-4o", "vision", 16384), ("deepseek-chat", "vision", 1), ("claude-new", "text", 64001), ("mystery", "vision", 10**9), ("glm-4.5", "text", 0),
    )
    got = {r.model: (r.vendor, r.problem) for r in catalog.check_requests(asked).collect()}
    assert got == {
        "GPT-4o": ("openai", None), "deepseek-chat": ("deepseek", "needs_images"), "claude-new": ("claude", "too_many_tokens"),
        "mystery": (None, None), "glm-4.5": ("zhipu", "tokens_not_positive"),
    }
    assert value(spark, catalog.provider_key(F.lit(" Google "))) == "gemini"
    assert catalog.accepted_providers(spark).count() == 19
    assert catalog.models(spark).where(catalog.takes_images(F.col("inputs"))).count() == 14
