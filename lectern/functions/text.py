"""Transcript text and media-time rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and patterns that decide results.
WIDE_CHARS = "，。！？：；　"
NARROW_CHARS = ",.!?:; "
BRACKETED = r"(?d)[\[【（(].*?[\]】）)]"
SENTENCE_END = "。.!?！？"
SPACE = r"[\s\x1c-\x1f]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"
SRT_TIME = r"\d{1,2}:\d{2}:\d{2}[,.]\d{3}"
VTT_TIME = r"\d{1,2}:\d{2}:\d{2}\.\d{3}|\d{1,2}:\d{2}\.\d{3}"
FRAME_NAME_TIME = r"(\d+)h(\d+)m(\d+)s(\d+)?ms?"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Lines of a text, at every Unicode line boundary."""
    return F.split(text, LINE_BREAK)


def clean_transcript(raw: Column) -> Column:
    """Spoken-text cleanup: asides, wide punctuation, repeats, sentence breaks."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), BRACKETED, "")
    text = F.translate(text, WIDE_CHARS, NARROW_CHARS)
    rows = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    text = F.array_join(collapse_repeats(rows), "\n")
    text = F.regexp_replace(text, f"(?U)([{SENTENCE_END}]){SPACE}*", "$1\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    text = F.regexp_replace(text, " {2,}", " ")
    return strip(text)


def collapse_repeats(rows: Column) -> Column:
    """Drop each element that equals the one before it."""
    return let(rows, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x != F.get(all_, i - 1))))


def strip_timestamps(text: Column) -> Column:
    """Plain lines of a subtitle file, without its furniture."""
    rows = F.transform(lines(text), strip)
    furniture = rf"^WEBVTT|{DIGITS}|^\d{{1,2}}:\d{{2}}(:\d{{2}})?[,.]\d{{3}}{SPACE}*-->"
    return F.array_join(F.filter(rows, lambda x: (x != "") & ~x.rlike(f"(?U){furniture}")), "\n")


def parse_time(stamp: Column) -> Column:
    """``H:MM:SS,mmm`` or ``MM:SS.mmm`` to seconds."""
    parts = F.split(F.translate(strip(stamp), ",", "."), ":")
    hours = F.when(F.size(parts) == 3, F.get(parts, F.lit(0)).cast("long")).otherwise(F.lit(0))
    back = F.size(parts)
    minutes = F.get(parts, back - 2).cast("long")
    seconds = F.get(parts, back - 1).cast("double")
    return (hours * 3600 + minutes * 60).cast("double") + seconds


def srt_time(seconds: Column, clamp: bool = True) -> Column:
    """Seconds to ``HH:MM:SS,mmm``; milliseconds round half to even. Null stays null."""
    ms = F.rint(seconds * 1000).cast("long")
    if clamp:
        ms = F.greatest(ms, F.lit(0).cast("long"))
    milli = F.pmod(ms, F.lit(1000))
    whole = ((ms - milli) / 1000).cast("long")
    second = F.pmod(whole, F.lit(60))
    minute = F.pmod(((whole - second) / 60).cast("long"), F.lit(60))
    hour = ((whole - F.pmod(whole, F.lit(3600))) / 3600).cast("long")
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d,%03d", hour, minute, second, milli))


def srt_range(start: Column, end: Column, clamp: bool = True) -> Column:
    return F.concat(srt_time(start, clamp), F.lit(" --> "), srt_time(end, clamp))


def hms(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS``, truncating; null and negative read as zero."""
    total = F.floor(F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0))).cast("long")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(total / 3600),
        F.floor(total / 60) % 60,
        total % 60,
    )


def capture_label(seconds: Column) -> Column:
    """Seconds to the ``HH:MM:SS.mmm`` position given to a frame grabber."""
    return F.format_string(
        "%02d:%02d:%06.3f",
        F.floor(seconds / 3600).cast("long"),
        F.floor(seconds % 3600 / 60).cast("long"),
        seconds % 60,
    )


def frame_name_time(path: Column) -> Column:
    """Seconds encoded in a frame file name; 0.0 when there are none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")

    def part(i: int) -> Column:
        return F.coalesce(
            F.nullif(F.regexp_extract(stem, FRAME_NAME_TIME, i), F.lit("")).cast("long"), F.lit(0)
        )

    return (part(1) * 3600 + part(2) * 60 + part(3)).cast("double") + part(4) / 1000.0


def frame_name(seconds: Column, source: Column, position: Column) -> Column:
    """File name of the ``position``-th frame of a source."""
    return F.format_string(
        "frame_%02dh%02dm%02ds%03dms_%s_%03d.jpg",
        F.floor(seconds / 3600).cast("long"),
        F.floor(seconds % 3600 / 60).cast("long"),
        F.floor(seconds % 60).cast("long"),
        F.rint(seconds % 1 * 1000).cast("long"),
        source,
        position,
    )


def one_decimal(seconds: Column) -> Column:
    """A non-negative number with one decimal, rounding the exact binary value.

    ``%.1f`` on the JVM rounds the printed form, so 0.25 would become 0.3.
    """
    whole = F.floor(seconds)
    part = seconds - whole
    tenth = F.floor(part * 10)
    odd = tenth * 2 + 1
    # Both sides are exact in binary close to a tie.
    high, low = part * 16 - odd, part * -4
    up = (high > low) | ((high == low) & (tenth % 2 == 1))
    tenths = (whole * 10 + tenth + up.cast("long")).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def display_start(start: Column) -> Column:
    return F.coalesce(start, F.lit(0.0))


def display_end(start: Column, end: Column) -> Column:
    """A missing or zero end shows the start."""
    return F.coalesce(F.nullif(end, F.lit(0.0)), display_start(start))


def midpoint(start: Column, end: Column) -> Column:
    return (display_start(start) + display_end(start, end)) / 2.0


def repair_midpoint(start: Column, end: Column) -> Column:
    """As ``midpoint``, but a missing end counts as zero."""
    return (F.coalesce(start, F.lit(0.0)) + F.coalesce(end, F.lit(0.0))) / 2.0


def python_float(number: Column) -> Column:
    """A double as Python prints it: fewest digits that give it back, exponents below -4 and from 16 on."""
    number = number.cast("double")
    tries = [F.format_string(f"%.{p}e", number) for p in range(17)]
    fewest = F.coalesce(*[F.when(t.cast("double") == number, t) for t in tries], tries[-1])

    def printed(sci: Column) -> Column:
        sign = F.when(F.startswith(sci, F.lit("-")), "-").otherwise("")
        digits = F.regexp_replace(F.regexp_extract(sci, r"([0-9.]+)e", 1), r"\.", "")
        power = F.regexp_extract(sci, r"e([+-][0-9]+)", 1).cast("int")
        n = F.length(digits)
        whole = F.when(power >= n - 1, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(
            F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        body = F.when((power < -4) | (power >= 16), F.regexp_replace(sci, "-(?=.*e)", "")).when(power < 0, small).otherwise(whole)
        return F.concat(sign, body)

    return (
        F.when(F.isnan(number), "NaN")
        .when(number == float("inf"), "Infinity")
        .when(number == float("-inf"), "-Infinity")
        .when(number == 0, F.when(F.startswith(number.cast("string"), F.lit("-")), "-0.0").otherwise("0.0"))
        .when(number.isNotNull(), let(fewest, printed))
    )


# The short escapes of JSON.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_ascii(text: Column) -> Column:
    """A JSON string in ASCII: everything else as ``\\uXXXX``, in pairs above U+FFFF."""

    def escaped(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        out = F.when(F.rlike(char, F.lit(r"\A[ -~]\z")), char).otherwise(
            F.regexp_replace(units, "(.{4})", r"\\u$1")
        )
        for raw, short in _ESCAPES.items():
            out = F.when(char == raw, short).otherwise(out)
        return out

    plain = F.rlike(text, F.lit(r'\A[ !#-\[\]-~]*\z'))
    inner = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.concat(F.lit('"'), inner, F.lit('"'))
