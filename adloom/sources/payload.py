"""JSON payloads of boards: page state and search APIs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import salary, urls
from adloom.functions.columns import let
from adloom.functions.text import collapse_ws

PLAINTEXT = re.compile(r'"plaintext"\s*:\s*"((?:\\.|[^"\\])*)"')
_ESCAPE = re.compile(r"\\(?:([abfnrtv\\\"])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.)|$)", re.DOTALL)
_PLAIN = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}

DEALLS_JOB = (
    "struct<role: string, slug: string, salaryType: string, salaryRange: struct<start: bigint, `end`: bigint>, responsibilities: string, requirements: string, "
    "company: struct<name: string, slug: string>>"
)
DEALLS_API = f"struct<code: int, data: struct<docs: array<{DEALLS_JOB}>, page: int, totalPages: int, totalDocs: int>, _bad: string>"
NEXT_QUERIES = "struct<props: struct<pageProps: struct<dehydratedState: struct<queries: array<struct<queryKey: array<string>, state: struct<data: string>>>>>>>"
KEY_JOB, KEY_LIST = "/v1/job-portal/job/slug", "/v1/explore-job/job"


def unescaped(s: str) -> str | None:
    """A quoted string's value; null for escapes of another language than its writer's: `\\/`, surrogates, raw newlines."""
    if "\n" in s:
        return None
    bad = False

    def one(m: re.Match) -> str:
        nonlocal bad
        plain, x, u, long, octal, other = m.groups()
        if plain:
            return _PLAIN[plain]
        number = int(x or u or long, 16) if (x or u or long) else int(octal, 8) if octal else None
        if number is None or number > 0x10FFFF or 0xD800 <= number < 0xE000 or octal and number > 255:
            bad = True
            return ""
        return chr(number)

    out = _ESCAPE.sub(one, s)
    return None if bad else out


def plaintexts(html: str) -> list[str]:
    """Texts of a post that its page holds as JSON."""
    found = (unescaped(m) for m in PLAINTEXT.findall(html))
    return [t for x in found if x is not None and (t := x.strip())]


def _job_struct(job: Column, origin: Column) -> Column:
    href = urls.dealls_href(job["slug"], job["company"]["slug"])
    title = collapse_ws(F.coalesce(job["role"], F.lit("")))

    def told(a: Column) -> Column:
        good = (a["href"] != "") & urls.is_detail_url("dealls", a["url"])
        return F.struct(F.when(good, a["url"]).alias("source_url"), F.when(a["title"] == "", a["url"]).otherwise(a["title"]).alias("title"),
                        collapse_ws(F.coalesce(job["company"]["name"], F.lit(""))).alias("company"),
                        salary.dealls_salary(job["salaryType"], job["salaryRange"]["start"], job["salaryRange"]["end"]).alias("salary"))

    return let(F.struct(href.alias("href"), urls.canonical_url(F.concat(origin, href)).alias("url"), title.alias("title")), told)


def dealls_api_ads(pages: DataFrame, body: str = "body", origin: str = "https://dealls.com") -> DataFrame:
    """Rows (…, ok, total_pages, ads) of API pages: ok is false for bad JSON and codes other than 0 and 200; ads is in order."""
    env = F.from_json(body, DEALLS_API, {"columnNameOfCorruptRecord": "_bad"})
    df = pages.withColumn("_env", env)
    ok = F.col("_env").isNotNull() & F.col("_env._bad").isNull() & F.try_parse_json(body).isNotNull() & F.coalesce(F.col("_env.code"), F.lit(0)).isin(0, 200)
    ads = F.filter(F.transform(F.coalesce(F.col("_env.data.docs"), F.array()), lambda j: _job_struct(j, F.lit(origin))), lambda a: a["source_url"].isNotNull())
    return df.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("total_pages", F.col("_env.data.totalPages")).withColumn("ads", F.when(F.col("ok"), ads)).drop("_env", body)


def next_queries(next_data: Column) -> Column:
    return F.coalesce(F.from_json(next_data, NEXT_QUERIES)["props"]["pageProps"]["dehydratedState"]["queries"], F.array())


def dealls_job(next_data: Column) -> Column:
    """The job of a page's state: of the first job query with a role, else null."""
    jobs = F.transform(F.filter(next_queries(next_data), lambda q: F.get(q["queryKey"], F.lit(0)).contains(KEY_JOB)), lambda q: F.from_json(q["state"]["data"], DEALLS_JOB))
    return F.get(F.filter(jobs, lambda j: F.trim(F.coalesce(j["role"], F.lit(""))) != ""), F.lit(0))


def dealls_listing(next_data: Column, origin: Column) -> Column:
    """Ads of a listing page's state: of the first list query whose first page has any; empty if none."""
    page = f"struct<pages: array<struct<docs: array<{DEALLS_JOB}>>>>"
    lists = F.transform(F.filter(next_queries(next_data), lambda q: F.get(q["queryKey"], F.lit(0)).contains(KEY_LIST)), lambda q: F.get(F.from_json(q["state"]["data"], page)["pages"], F.lit(0))["docs"])
    docs = F.get(F.filter(lists, lambda d: F.size(d) > 0), F.lit(0))
    return F.filter(F.transform(F.coalesce(docs, F.array()), lambda j: _job_struct(j, origin)), lambda a: a["source_url"].isNotNull())


def _pick(v: Column, names: tuple[str, ...], kinds: str, to: str) -> Column:
    """The first of several spellings whose value has a fitting type; other types are passed over."""
    one = lambda n: let(F.try_variant_get(v, f"$.{n}", "variant"), lambda x: F.when(F.schema_of_variant(x).rlike(kinds), F.try_variant_get(x, "$", to)))
    return F.coalesce(*map(one, names))


def kalibrr_ad(job: Column, origin: Column) -> Column:
    """The ad of a job variant, snake or camel case: a struct with source_url null where the job has no address of its own, and raw HTML of both description parts."""
    text = lambda v, *n: F.coalesce(_pick(v, n, "^STRING$", "string"), F.lit(""))
    number = lambda *n: _pick(job, n, r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "double").cast("long")
    whole = lambda *n: F.coalesce(_pick(job, n, "^BIGINT$", "bigint"), number(*n))
    company = _pick(job, ("company", "company_info", "companyInfo"), "^OBJECT", "variant")

    def read(c: Column) -> Column:
        return F.struct(text(c, "code").alias("code"), collapse_ws(text(c, "name")).alias("by"), whole("id").alias("id"), text(job, "slug").alias("slug"), collapse_ws(text(job, "name")).alias("title"),
                        collapse_ws(text(job, "company_name", "companyName")).alias("named"), whole("base_salary", "baseSalary").alias("low"), whole("maximum_salary", "maximumSalary").alias("high"))

    def address(r: Column) -> Column:
        url = lambda href: urls.canonical_url(F.concat(origin, href))
        return let(urls.kalibrr_href(r["code"], r["id"], r["slug"]), lambda h: let(url(h), lambda u: F.when((h != "") & urls.is_detail_url("kalibrr", u), u)))

    def told(r: Column) -> Column:
        shown, period = _pick(job, ("salary_shown", "salaryShown"), "^BOOLEAN$", "boolean"), text(job, "salary_interval", "salaryInterval")
        return let(address(r), lambda own: F.struct(
            own.alias("source_url"), F.when(r["title"] == "", own).otherwise(r["title"]).alias("title"), F.when(r["named"] == "", r["by"]).otherwise(r["named"]).alias("company"),
            salary.kalibrr_salary(shown, r["low"], r["high"], period).alias("salary"), text(job, "description").alias("description_html"), text(job, "qualifications").alias("qualifications_html")))

    return let(let(company, read), told)


def kalibrr_api_ads(pages: DataFrame, body: str = "body", origin: str = "https://www.kalibrr.id") -> DataFrame:
    """Rows (…, ok, count, ads) of search pages; ads is in order, jobs without an address are left out."""
    v = F.try_parse_json(body)
    df = pages.withColumn("_v", v)
    jobs = F.coalesce(F.try_variant_get(F.col("_v"), "$.jobs", "array<variant>"), F.array().cast("array<variant>"))
    ads = F.filter(F.transform(jobs, lambda j: kalibrr_ad(j, F.lit(origin))), lambda a: a["source_url"].isNotNull())
    return df.withColumn("ok", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))).withColumn("count", F.coalesce(F.try_variant_get(F.col("_v"), "$.count", "int"), F.lit(0))).withColumn("ads", ads).drop("_v", body)


def sections(first: Column, second: Column, labels: tuple[str, str]) -> Column:
    """Two texts under their headings with an empty line between; empty ones are left out."""
    part = lambda t, h: F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit(h + "\n"), t))
    return F.concat_ws("\n\n", part(first, labels[0]), part(second, labels[1]))
