"""Text as Columns: white space, structured text, lines, links in messages, byte cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.columns import let

#: Unicode white space, as a regex class body; Java's `\s` alone is ASCII.
SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip_ws(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_ws(c: Column) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def cleanup_text(c: Column) -> Column:
    """Lines collapsed, one empty line in a row at most, none at start or end."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    flat = F.trim(F.regexp_replace(F.regexp_replace(lines, f"[{SPACE}&&[^\n]]+", " "), " ?\n ?", "\n"))
    return F.regexp_replace(F.regexp_replace(flat, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def caption_lines(c: Column, n: int = 8) -> Column:
    """The first n lines with text, stripped."""
    lines = F.transform(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n"), strip_ws)
    return F.slice(F.filter(lines, lambda x: x != ""), 1, n)


def extract_urls(c: Column) -> Column:
    """Distinct http(s) links of a message in the order they first stand, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,);\]]+$", "")))


def cut_bytes(c: Column, n: int) -> Column:
    """The longest start of whole characters in n bytes of UTF-8."""
    return let(c, lambda x: F.when(F.octet_length(x) <= n, x).otherwise(F.rtrim(F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, n).cast("string")), F.lit("�"))))


def parse_ts(c: Column) -> Column:
    """A timestamp from text as stored, `2024-01-31 08:15:00` in the session's zone (UTC); other text is null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def format_ts(c: Column) -> Column:
    """The stored text of a timestamp."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
