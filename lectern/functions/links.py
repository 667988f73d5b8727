"""Share text, video links and subtitle language rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Patterns and names that decide results.
URL_CHARS = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
SHARE_TRAILERS = ".,;:!?)]}，。；：！？、】》"
COMMAND_TRAILERS = "，。！？；：、）】》\"'"
LOCAL_VIDEO = r"(?iU)[/~]\S+\.(?:mp4|mkv|avi|mov|flv|wmv|webm)"
VIDEO_SUFFIXES = ["mp4", "mkv", "avi", "mov", "flv", "wmv", "webm"]
PLATFORM_HOSTS = {
    "youtube": ["youtube.com", "youtu.be"],
    "bilibili": ["bilibili.com", "b23.tv"],
    "douyin": ["douyin.com", "iesdouyin.com"],
    "kuaishou": ["kuaishou.com", "gifshow.com", "chenzhongtech.com"],
}
VIDEO_ID_PATTERNS = {
    "bilibili": [r"(BV[0-9A-Za-z]+)"],
    "youtube": [r"(?:v=|youtu\.be/|shorts/|live/|embed/)([0-9A-Za-z_-]{11})"],
    "douyin": [r"/video/(\d+)", r"modal_id=(\d+)", r"aweme_id=(\d+)"],
    "kuaishou": [r"(?U)short-video/(\w+)", r"(?U)photoId=(\w+)", r"(?U)photoId%3D(\w+)"],
}
HOST = r"(?i)\A[\x00-\x20]*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^:/?#]*)"
PAGE = r"\A[^#]*?[?&]p=([^&#]+)"
ZH_LABEL = "zh|cn|中文|汉语|简体|繁體"
EN_LABEL = "en|english|英文"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _rstrip(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def extract_url(text: Column) -> Column:
    """First link in free text, without glued-on punctuation."""
    return _rstrip(_first(text, f"(?i){URL_CHARS}", 0), SHARE_TRAILERS)


def extract_source(text: Column) -> Column:
    """First link, else first local video path, else empty."""
    return F.coalesce(
        _rstrip(_first(text, URL_CHARS, 0), COMMAND_TRAILERS),
        _rstrip(_first(text, LOCAL_VIDEO, 0), COMMAND_TRAILERS),
        F.lit(""),
    )


def host(url: Column) -> Column:
    """Lower-case host name, by pattern: share links hold characters that URI parsers refuse."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def platform(url: Column) -> Column:
    """Platform by host suffix, null for other hosts.

    One match finds the suffix and a literal map names it, so the host is
    computed once per row.
    """
    owner = {suffix: key for key, suffixes in PLATFORM_HOSTS.items() for suffix in suffixes}
    known = "|".join(suffix.replace(".", r"\.") for suffix in owner)
    suffix = F.regexp_extract(host(url), rf"(?:\A|\.)({known})\z", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in owner.items() for x in pair]), suffix)


def is_supported(url: Column) -> Column:
    return platform(url).isNotNull()


def is_video_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(VIDEO_SUFFIXES) + r")\z")


def has_video_source(text: Column) -> Column:
    """A link, or a video file name at the end or before a space."""
    return text.rlike("https?://") | F.lower(text).rlike(
        r"\.(" + "|".join(VIDEO_SUFFIXES) + r")( |\z)"
    )


def video_id(url: Column, platform_name: Column) -> Column:
    """Platform-specific id where the link shows it."""
    out = F.lit(None).cast("string")
    for key, patterns in VIDEO_ID_PATTERNS.items():
        out = F.when(platform_name == key, F.coalesce(*[_first(url, p) for p in patterns])).otherwise(out)
    return out


def canonical_douyin(url: Column) -> Column:
    return F.concat(F.lit("https://www.douyin.com/video/"), video_id(url, F.lit("douyin")))


def page_number(url: Column) -> Column:
    """Part number in the query string, 1 when absent."""
    return F.coalesce(_first(url, PAGE).try_cast("int"), F.lit(1))


def language(raw: Column) -> Column:
    """Two language families, else the trimmed label, else null."""
    label = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(label.rlike(ZH_LABEL), "zh")
        .when(label.rlike(EN_LABEL), "en")
        .otherwise(F.nullif(strip(raw), F.lit("")))
    )


def file_language(name: Column, video: Column) -> Column:
    """Language part of ``<video>.<lang>.<ext>``."""
    prefix = F.concat(video, F.lit("."))
    rest = F.substr(name, F.length(prefix) + 1)
    stem = F.regexp_replace(rest, r"\.[^.]*\z", "")
    plain = (name == F.concat(video, F.lit(".srt"))) | (name == F.concat(video, F.lit(".vtt")))
    return F.when(plain | ~F.startswith(name, prefix), "und").otherwise(
        F.coalesce(language(stem), F.lower(stem))
    )


def ms_to_seconds(raw: Column) -> Column:
    return raw.try_cast("double") / 1000.0


def first_nested_url(photo_url: Column, adaptation_sets: Column) -> Column:
    """Direct link, else the first non-empty url or backup in nested representations."""
    nested = F.flatten(F.transform(adaptation_sets, lambda a: F.coalesce(a["representation"], F.array())))
    urls = F.flatten(F.transform(nested, lambda r: F.array(r["url"], r["backupUrl"])))
    return F.coalesce(
        F.nullif(photo_url, F.lit("")), F.get(F.filter(urls, lambda u: u != ""), F.lit(0))
    )


def first_listed_url(*lists: Column) -> Column:
    """First entry over several url lists, in order."""
    return F.get(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), F.lit(0))
