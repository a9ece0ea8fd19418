"""Fields of a hiring post, read from its caption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.columns import let, some
from adloom.functions.salary import find_salary, truncate_salary
from adloom.functions.text import SPACE, caption_lines, collapse_ws, strip_ws

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # word edges by ASCII letters
#: Fixed values.
HIRING = rf"(?iu)(?:we['’]?re\s+hiring|we\s+are\s+hiring|now\s+hiring|{_B}hiring{_E}|lowongan(?:\s+kerja)?)\s*[-–—|:]\s*(.+)"
PT_COMPANY = rf"(?iu){_B}P\.?\s*T\.?\s+[A-Za-z][A-Za-z0-9&.,'’\- ]{{1,80}}"
SUFFIX = rf"(?iu)(?:Pte\.?\s*Ltd\.?|Ltd\.?|Limited|Inc\.?|Incorporated|LLC|GmbH)(?:(?<=[A-Za-z0-9_]){_E}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
MINIMUM_WAGE = rf"(?iu)(?:salary|compensation|pay|gaji|upah)\s*[:\-]?\s*(UMR|UMK){_E}"
ROLE = (
    rf"(?iu){_B}(staff|programmer|developer|engineer|manager|operator|assistant|analyst|designer|intern|officer|admin"
    rf"|administrasi|warehouse|production|packing|quality|marketing|finance|accounting){_E}"
)
STOPS = (
    "join", "joining", "at", "with", "our", "the", "a", "an", "for", "and", "from", "by", "di", "ke", "yang", "dari",
    "hiring", "lowongan", "kerja", "we", "now", "looking", "need", "needed",
)
MARKS = "📍💰🕒📞📧"


def looks_like_org(c: Column) -> Column:
    """No role word, and a legal form or words of which at least half the letters are capitals."""
    count = lambda w, kind: F.length(F.regexp_replace(w, rf"[^\p{{{kind}}}]", ""))

    def test(c: Column) -> Column:
        legal = F.lower(c).rlike(r"pt |^pt\.| ltd| inc| pte| llc")
        capital = F.forall(F.split(collapse_ws(c), " "), lambda w: (count(w, "L") > 0) & (count(w, "Lu") * 2 >= count(w, "L")))
        return (c != "") & ~c.rlike(ROLE) & (legal | capital)

    return let(strip_ws(c), test)


def _clean_title(c: Column) -> Column:
    c = F.aggregate(F.array(*map(F.lit, MARKS)), strip_ws(c), lambda x, mark: F.when(F.position(mark, x) > 1, strip_ws(F.substring(x, F.lit(1), F.position(mark, x) - 1))).otherwise(x))
    return strip_ws(F.regexp_replace(c, r"^[^\p{L}\p{N}]+", ""))


def _clean_company(c: Column) -> Column:
    return collapse_ws(F.regexp_replace(strip_ws(c), r"[^\p{L}\p{N}.)]+$", ""))


def _hiring_rests(caption: Column) -> Column:
    return F.transform(F.filter(caption_lines(caption), lambda x: x.rlike(HIRING)), lambda x: F.regexp_extract(x, HIRING, 1))


def caption_title(c: Column) -> Column:
    """What follows the hiring words of the first line that names a role."""
    found = F.filter(F.transform(_hiring_rests(c), _clean_title), lambda t: (t != "") & ~looks_like_org(t))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def _name_before(before: Column) -> Column:
    """Up to six capitalised words that stand right before, in order; a state of (open, words) is folded over them from the back."""
    words = F.transform(F.filter(F.split(before, f"[{SPACE},;]+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "^[.,:;!?\"']+|[.,:;!?\"']+$", ""))
    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("words"))

    def step(s: Column, w: Column) -> Column:
        good = s["open"] & (F.size(s["words"]) < 6) & w.rlike(r"^\p{Lu}") & ~F.lower(F.regexp_replace(w, "^[.,:;!'’]+|[.,:;!'’]+$", "")).isin(*STOPS)
        return F.struct(good.alias("open"), F.when(good, F.concat(F.array(w), s["words"])).otherwise(s["words"]).alias("words"))

    return F.aggregate(F.reverse(words), start, step, lambda s: F.array_join(s["words"], " "))


def _by_suffix(c: Column) -> Column:
    """The first legal suffix with a name before it."""
    def look(p: Column) -> Column:
        before = lambda i: F.array_join(F.transform(F.sequence(F.lit(0), i), lambda k: F.concat(F.get(p["gaps"], k), F.when(k < i, F.get(p["found"], k)).otherwise(F.lit("")))), "")
        names = F.transform(p["found"], lambda s, i: F.struct(_name_before(before(i)).alias("name"), strip_ws(s).alias("suffix")))
        named = F.transform(F.filter(names, lambda n: n["name"] != ""), lambda n: _clean_company(F.concat_ws(" ", n["name"], n["suffix"])))
        return F.get(F.filter(named, lambda x: x != ""), F.lit(0))

    return let(F.struct(F.regexp_extract_all(c, F.lit(SUFFIX), F.lit(0)).alias("found"), F.split(c, SUFFIX, -1).alias("gaps")), look)


def caption_company(c: Column) -> Column:
    """A `PT` name, else a name with a legal suffix, else an organisation in a hiring line, else ''."""
    def look(x: Column) -> Column:
        line = F.get(F.filter(F.transform(_hiring_rests(x), _clean_company), looks_like_org), F.lit(0))
        return some(_clean_company(F.regexp_extract(x, PT_COMPANY, 0)), _by_suffix(x), line)

    return let(F.coalesce(c, F.lit("")), look)


def caption_salary(c: Column) -> Column:
    """A salary in the text, else a minimum wage by name, else ''."""
    return truncate_salary(collapse_ws(some(find_salary(c), F.regexp_extract(F.coalesce(c, F.lit("")), MINIMUM_WAGE, 0))))


def caption_fields(c: Column) -> Column:
    """A struct of title ('' if it is the company), company and salary."""
    def told(f: Column) -> Column:
        same = (f["company"] != "") & (F.lower(F.trim(f["title"])) == F.lower(F.trim(f["company"])))
        return F.struct(F.when(same, "").otherwise(f["title"]).alias("title"), f["company"].alias("company"), f["salary"].alias("salary"))

    return let(c, lambda x: let(F.struct(caption_title(x).alias("title"), caption_company(x).alias("company"), caption_salary(x).alias("salary")), told))


def best_caption(seed: Column, texts: Column) -> Column:
    """The longest text (in bytes) of which one is a start of the other, once white space is collapsed; the seed if none is longer."""
    def longest(s: Column) -> Column:
        fit = lambda t: let(collapse_ws(t), lambda x: (s["flat"] != "") & (x != "") & (x.startswith(s["flat"]) | s["flat"].startswith(x)))
        return F.aggregate(F.filter(texts, fit), s["seed"], lambda best, t: F.when(F.octet_length(t) > F.octet_length(best), t).otherwise(best))

    return strip_ws(let(seed, lambda x: let(F.struct(x.alias("seed"), collapse_ws(x).alias("flat")), longest)))
