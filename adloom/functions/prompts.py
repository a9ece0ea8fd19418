"""Prompts for letters and field extraction, and the answers' decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
LETTER_SYSTEM = (
    "You write tailored cover letters for job applications. "
    "Use only the candidate profile and job description given; never invent employers, degrees, skills, or experience. "
    "Output the letter body only, no markdown fences."
)
EXTRACT_SYSTEM = (
    "You extract job posting fields from unstructured social media text. "
    "Use only the post; never invent employers, job titles, or salaries. "
    "If a field is not clearly present, return an empty string. "
    "Output a JSON object only, no markdown fences."
)
PROFILE_KEYS = ("full_name", "summary", "work_history", "skills", "tone_preferences")
SIGNATURE = "signature"


def profile_section(profile: Column) -> Column:
    """The known keys in order with trimmed values, then other keys by name with their values as they are; blank ones and the signature never."""
    line = lambda k, v: F.concat(F.lit("- "), k, F.lit(": "), v, F.lit("\n"))
    known = [F.when(F.trim(profile[k]) != "", line(F.lit(k), F.trim(profile[k]))).otherwise("") for k in PROFILE_KEYS]
    known = [F.coalesce(k, F.lit("")) for k in known]
    extra = F.map_filter(profile, lambda k, v: ~k.isin(*PROFILE_KEYS, SIGNATURE) & (F.trim(v) != ""))
    rest = F.array_join(F.transform(F.array_sort(F.map_keys(extra)), lambda k: line(k, extra[k])), "")
    return F.concat(F.lit("Candidate profile:\n"), *known, rest)


def cover_letter_prompt(profile: Column, title: Column, company: Column, description: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(profile_section(profile), F.lit("\nJob:\nTitle: "), some(title), F.lit("\nCompany: "), some(company),
                    F.lit("\nDescription:\n"), some(description), F.lit("\n\nWrite a tailored cover letter."))


def paste_prompt(profile: Column, system: Column) -> Column:
    """One text to paste elsewhere; the ad is left open."""
    return F.concat(F.when(F.trim(F.coalesce(system, F.lit(""))) == "", LETTER_SYSTEM).otherwise(system), F.lit("\n\n"), profile_section(profile),
                    F.lit("\nJob Ad:\n\n\nWrite a tailored cover letter."))


def with_signature(answer: Column, signature: Column) -> Column:
    s = F.trim(F.coalesce(signature, F.lit("")))
    return F.when(s != "", F.concat(answer, F.lit("\n\n"), s)).otherwise(answer)


def missing_fields(title: Column, company: Column, salary: Column) -> Column:
    """Names of the empty fields, in order."""
    blank = lambda c, name: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(name))
    return F.array_compact(F.array(blank(title, "title"), blank(company, "company"), blank(salary, "salary")))


def extract_prompt(missing: Column, post: Column) -> Column:
    return F.concat(F.lit("Extract only these fields from the post: "), F.array_join(missing, ", "),
                    F.lit(".\nReturn JSON with those keys. Use empty strings when unknown.\n\nPost:\n"), post)


def decode_fields(answer: Column) -> Column:
    """A struct of title, company and salary from an answer; null if its JSON is bad. Code fences and text around the object go."""
    body = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json|JSON)?", ""), r"```$", "")
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.when(found != "", found).otherwise(F.trim(body)))
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))
    value = lambda name: F.trim(F.coalesce(F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string")), F.lit("")))
    good = F.schema_of_variant(v).startswith("OBJECT")
    for name in ("title", "company", "salary"):
        good = good & kind(name).isin("STRING", "VOID")
    return F.when(good, F.struct(*[value(n).alias(n) for n in ("title", "company", "salary")]))
