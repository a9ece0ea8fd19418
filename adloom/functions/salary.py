"""Salary text as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.columns import let, some
from adloom.functions.text import collapse_ws, cut_bytes

MAX_BYTES = 120
#: Fixed value: what counts as a salary in free text. `[-–—to]+` is a class of characters, and amounts need no digit.
SALARY_TEXT = (
    r"(?:"
    r"(?:salary|compensation|pay|gaji|upah)\s*[:\-]?\s*"
    r"(?:(?:sgd|usd|idr|rp\.?|rm|myr|\$|s\$)\s*)?"
    r"[\d.,]+\s*(?:k|jt|juta|million|m)?"
    r"(?:\s*[-–—to]+\s*(?:(?:sgd|usd|idr|rp\.?|rm|myr|\$|s\$)\s*)?[\d.,]+\s*(?:k|jt|juta|million|m)?)?"
    r"(?:\s*(?:/\s*(?:mo(?:nth)?|yr|year|hour|hr)|per\s+(?:month|year|hour)))?"
    r"|"
    r"(?:sgd|usd|idr|rp\.?|rm|myr|s\$|\$)\s*[\d.,]+\s*(?:k|jt|juta|million|m)?"
    r"(?:\s*[-–—to]+\s*(?:(?:sgd|usd|idr|rp\.?|rm|myr|\$|s\$)\s*)?[\d.,]+\s*(?:k|jt|juta|million|m)?)?"
    r"(?:\s*(?:/\s*(?:mo(?:nth)?|yr|year|hour|hr)|per\s+(?:month|year|hour)))?"
    r")"
)
#: What stands where a board tells no salary.
DEFAULTS = {"jobstreet": "Salary Undisclosed", "glints": "Salary Undisclosed", "dealls": "Negotiable", "kalibrr": "Gaji Tidak Diumumkan"}
#: How a period is told.
PERIODS = {
    "month": "/ bulan", "monthly": "/ bulan", "year": "/ tahun", "yearly": "/ tahun", "annual": "/ tahun",
    "week": "/ minggu", "weekly": "/ minggu", "day": "/ hari", "daily": "/ hari", "hour": "/ jam", "hourly": "/ jam",
}


def find_salary(c: Column, strict: bool = False) -> Column:
    """The first salary in free text, else ''; strict: only one with a digit."""
    c = F.coalesce(c, F.lit(""))
    if not strict:
        return F.regexp_extract(c, "(?iu)" + SALARY_TEXT, 0)
    found = F.filter(F.regexp_extract_all(c, F.lit("(?iu)" + SALARY_TEXT), F.lit(0)), lambda x: x.rlike(r"\d"))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def looks_like_salary(c: Column) -> Column:
    return let(c, lambda x: F.lower(x).rlike("salary|compensation|gaji|negotiable") | x.rlike("(?iu)" + SALARY_TEXT))


def looks_like_glints_salary(c: Column) -> Column:
    """Undisclosed, or a currency (in this case of letters) and a digit."""
    return let(c, lambda x: F.lower(x).contains("undisclosed") | (x.rlike(r"Rp|IDR|SGD|USD|\$") & x.rlike("[0-9]")))


def truncate_salary(c: Column) -> Column:
    return cut_bytes(c, MAX_BYTES)


def format_idr(c: Column) -> Column:
    """Rupiah with dots between thousands, without a sign."""
    return F.concat(F.lit("Rp"), F.replace(F.format_number(F.abs(c), 0), F.lit(","), F.lit(".")))


def _range(low: Column, high: Column) -> Column:
    both = (low > 0) & (high > 0) & (low != high)
    return F.when(both, F.concat(format_idr(low), F.lit(" – "), format_idr(high))).when(low > 0, format_idr(low)).otherwise(format_idr(high))


def dealls_salary(kind: Column, start: Column, end: Column) -> Column:
    ends = F.struct(F.coalesce(start, F.lit(0)).cast("long").alias("low"), F.coalesce(end, F.lit(0)).cast("long").alias("high"))
    return let(ends, lambda e: F.when(F.lower(F.trim(kind)) == "unpaid", "Unpaid").when((e["low"] <= 0) & (e["high"] <= 0), DEFAULTS["dealls"]).otherwise(_range(e["low"], e["high"])))


def kalibrr_salary(shown: Column, base: Column, top: Column, period: Column) -> Column:
    ends = F.struct(F.coalesce(base, F.lit(0)).cast("long").alias("low"), F.coalesce(top, F.lit(0)).cast("long").alias("high"))
    word = F.lower(F.trim(F.coalesce(period, F.lit(""))))
    suffix = F.coalesce(F.create_map(*[F.lit(x) for p in PERIODS.items() for x in p])[word], F.lit(""))
    amount = lambda e: F.rtrim(F.concat_ws(" ", _range(e["low"], e["high"]), suffix))
    return let(ends, lambda e: F.when((shown == F.lit(False)) | ((e["low"] <= 0) & (e["high"] <= 0)), DEFAULTS["kalibrr"]).otherwise(amount(e)))


def default_salary(board: Column, c: Column) -> Column:
    """The board's own words where there is no salary; '' for others."""
    none = reduce(lambda out, b: F.when(board == b[0], b[1]).otherwise(out), DEFAULTS.items(), F.lit(""))
    return some(c, none)


def static_salary(meta: Column, nodes: Column, title: Column, description: Column) -> Column:
    """The salary meta, else the first salary node (they come in the order of selectors) that looks like one, else the first in title or description."""
    node = F.get(F.filter(F.coalesce(nodes, F.array().cast("array<string>")), lambda x: (x != "") & looks_like_salary(x)), F.lit(0))
    return truncate_salary(some(meta, node, collapse_ws(find_salary(title)), collapse_ws(find_salary(description))))
