"""Rule-based intent of an utterance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.links import extract_source, has_video_source
from lectern.functions.text import strip

# Command words, keywords and the message that decide results.
COMMANDS = ["run", "ask", "summarize", "help", "session"]
SUMMARY_WORDS = ["总结", "summarize", "笔记"]
VIDEO_WORDS = [
    "视频", "video", "youtube", "bilibili", "b站", "抖音", "douyin",
    "快手", "kuaishou", "教程", "转成文档", "生成教材",
]
NO_SOURCE = "error: 缺少视频链接或文件路径"


def is_command(text: Column) -> Column:
    """The first word is a command."""
    first = F.regexp_extract(strip(text), r"(?U)\A(\S+)", 1)
    return first.isin(COMMANDS)


def intent(text: Column) -> Column:
    """The command an utterance stands for."""
    lowered = F.lower(text)
    source = extract_source(text)
    return (
        F.when(is_command(text), text)
        .when(lowered.rlike("|".join(SUMMARY_WORDS)) & ~has_video_source(text), "summarize")
        .when(
            has_video_source(text),
            F.when(source != "", F.concat(F.lit("run "), source)).otherwise(NO_SOURCE),
        )
        .when(lowered.rlike("|".join(VIDEO_WORDS)), NO_SOURCE)
        .otherwise(F.concat(F.lit("ask "), text))
    )
