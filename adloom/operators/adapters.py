"""Page facts to ads, one rule set a board; all as Columns, in one small plan for each adapter that has pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions import captions, salary, urls
from adloom.functions.columns import let, some
from adloom.functions.text import cleanup_text, collapse_ws
from adloom.operators.ingest import fill_empty_fields
from adloom.sources.html import page_facts, text_with_breaks
from adloom.sources.payload import dealls_job, dealls_listing, kalibrr_ad, sections
from adloom.sources.tables import staged_by

_AD = "struct<source_url: string, title: string, company: string, salary: string, description: string>"
_ADS = f"array<{_AD}>"


def _ad(url: Column, title: Column, company: Column, pay: Column, description: Column | None = None) -> Column:
    return F.struct(url.alias("source_url"), title.alias("title"), F.coalesce(company, F.lit("")).alias("company"), pay.alias("salary"), (F.lit("") if description is None else F.coalesce(description, F.lit(""))).alias("description"))


def _distinct(ads: Column, key: str = "source_url") -> Column:
    """Without later ones of an address that stood before: sorted by address, the first of each is kept, in the old order."""
    def first(x: Column) -> Column:
        keyed = F.array_sort(F.transform(F.filter(x, lambda a: a[key].isNotNull()), lambda a, i: F.struct(a[key].alias("k"), i.alias("i"), a.alias("a"))))
        once = lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"]))
        return F.transform(F.array_sort(F.transform(let(keyed, once), lambda e: F.struct(e["i"].alias("i"), e["a"].alias("a")))), lambda e: e["a"])

    return let(ads, first)


def meta(facts: Column, name: str) -> Column:
    """The first content that is not empty of metas with that property or name."""
    found = F.filter(facts["metas"], lambda m: ((m["property"] == name) | (m["name"] == name)) & (m["content"] != ""))
    return F.coalesce(F.get(found, F.lit(0))["content"], F.lit(""))


def job_links(facts: Column, needles: tuple[str, ...] = urls.JOB_NEEDLES) -> Column:
    """Distinct job-like links of an unknown site in order: (href, title), the address where there is no text."""
    ok = lambda x: (x["href"] != "") & ~x["href"].startswith("#") & ~x["href"].startswith("mailto:") & x["url"].isNotNull() & urls.looks_like_job_path(urls.url_path(x["url"]), needles)
    hits = F.transform(F.filter(facts["links"], ok), lambda x: F.struct(x["url"].alias("href"), F.when(x["text"] == "", x["url"]).otherwise(x["text"]).alias("title")))
    return _distinct(hits, "href")


def page_kind(adapter: Column, requested: Column, final: Column, facts: Column, links: Column | None = None) -> Column:
    """detail, listing or empty. Two boards decide on the final address, two on the requested one, unknown sites on what the page holds (links: its job_links, if they are worked out already)."""
    links = job_links(facts) if links is None else links
    detail = (F.when(adapter == "jobstreet", urls.is_detail_url("jobstreet", final)).when(adapter == "dealls", urls.is_detail_url("dealls", final))
              .when(adapter == "glints", urls.is_detail_url("glints", requested)).when(adapter == "kalibrr", urls.is_detail_url("kalibrr", requested))
              .when(adapter == "threads", F.lit(True)).otherwise(F.size(links) < 3))
    return F.when(facts["error"].isNotNull(), "empty").when(detail, "detail").otherwise("listing")


def next_page_url(facts: Column) -> Column:
    """The first link to a next page that is not hidden, else null."""
    ok = lambda x: F.array_contains(F.split(x["rel"], r"\s+"), "next") & (x["hidden"] != "true") & (x["href"] != "")
    return F.get(F.filter(facts["links"], ok), F.lit(0))["url"]


def static_detail(facts: Column, url: Column) -> Column:
    long = F.filter(facts["bodies"], lambda b: F.octet_length(b["text"]) >= 40)
    key = lambda m: F.lower(F.concat_ws(" ", m["name"], m["property"]))
    pays = F.filter(F.transform(F.filter(facts["metas"], lambda m: key(m).rlike("salary|compensation")), lambda m: collapse_ws(m["content"])), lambda t: t != "")
    texts = F.struct(some(facts["h1"], facts["title"], url).alias("title"), F.coalesce(F.get(long, F.lit(0))["text"], F.lit("")).alias("description"))
    pay = lambda t: salary.static_salary(F.get(pays, F.lit(0)), facts["salary_nodes"], t["title"], t["description"])
    return let(texts, lambda t: _ad(url, t["title"], F.trim(meta(facts, "og:site_name")), pay(t), t["description"]))


def static_ads(facts: Column, url: Column, links: Column) -> Column:
    """The ads of an unknown site: its job-like links (see job_links) if it has three, else itself."""
    listed = lambda x: F.transform(x, lambda h: _ad(h["href"], h["title"], F.lit(""), F.lit("")))
    return F.when(F.size(links) >= 3, listed(links)).otherwise(F.array(static_detail(facts, url)))


def jobstreet_detail(facts: Column, url: Column) -> Column:
    a = facts["automation"]
    pay = salary.default_salary(F.lit("jobstreet"), a["job-detail-salary"])
    return _ad(urls.canonical_url(url), a["job-detail-title"], a["advertiser-name"], pay, cleanup_text(facts["automation_html"]))


def jobstreet_listing(facts: Column) -> Column:
    def one(c: Column) -> Column:
        own = F.get(F.filter(c["hrefs"], lambda h: h["own"] & (h["href"] != "")), F.lit(0))["url"]
        other = F.get(F.filter(c["hrefs"], lambda h: urls.is_detail_path("jobstreet", urls.url_path(h["href"]))), F.lit(0))["url"]
        pay = salary.default_salary(F.lit("jobstreet"), c["salary"])
        return let(urls.canonical_url(F.coalesce(own, other)), lambda url: _ad(url, some(c["title"], c["anchor"], url), c["company"], pay))

    return _distinct(F.filter(F.transform(facts["seek_cards"], one), lambda a: F.coalesce(a["source_url"], F.lit("")) != ""))


def glints_salary(nodes: Column, overviews: Column) -> Column:
    """The shortest text (in bytes) that looks like a salary; ties keep the earlier."""
    def shortest(texts: Column) -> Column:
        fits = F.filter(texts, lambda t: (t != "") & salary.looks_like_glints_salary(t))
        return F.aggregate(fits, F.lit(""), lambda best, t: F.when((best == "") | (F.octet_length(t) < F.octet_length(best)), t).otherwise(best))

    return some(shortest(nodes), shortest(overviews))


def glints_detail(facts: Column, url: Column) -> Column:
    pay = salary.default_salary(F.lit("glints"), glints_salary(facts["glints_salaries"], facts["glints_overviews"]))
    return _ad(urls.canonical_url(url), facts["h1"], facts["gtm_company"], pay, cleanup_text(facts["glints_html"]))


def glints_listing(facts: Column) -> Column:
    def one(c: Column) -> Column:
        found = F.get(F.filter(c["hrefs"], lambda h: urls.is_detail_path("glints", urls.url_path(h["href"]))), F.lit(0))["url"]
        pay = salary.default_salary(F.lit("glints"), glints_salary(c["salaries"], c["overviews"]))
        return let(urls.canonical_url(found), lambda url: _ad(F.when(urls.is_detail_url("glints", url), url), some(c["title"], c["anchor"], url), c["company"], pay))

    return _distinct(F.filter(F.transform(facts["glints_cards"], one), lambda a: a["source_url"].isNotNull()))


def dealls_dom_salary(leaves: Column) -> Column:
    """`Unpaid` wins at once it stands; a rupiah amount beats words, the shortest beats the longer; else `Negotiable` if named."""
    def step(best: Column, t: Column) -> Column:
        low, money = F.lower(t), t.contains("Rp") & t.rlike("[0-9]")
        better = (best == "") | ~best.contains("Rp") | (F.octet_length(t) < F.octet_length(best))
        return (F.when(low == "unpaid", "Unpaid").when(low == "negotiable", F.when(best == "", "Negotiable").otherwise(best))
                .when(money, F.when(better, t).otherwise(best)).when(low.contains("negotiable") & (best == ""), "Negotiable").otherwise(best))

    return F.aggregate(leaves, F.lit(""), step)


def dealls_detail(facts: Column, url: Column, job: Column, responsibilities: Column, requirements: Column) -> Column:
    """From the page's state (job, null if there is none), else from its nodes. The two HTML parts of the state come as text with breaks."""
    labels = ("Deskripsi Pekerjaan", "Kualifikasi")
    own = _ad(urls.canonical_url(url), collapse_ws(job["role"]), collapse_ws(F.coalesce(job["company"]["name"], F.lit(""))),
              salary.dealls_salary(job["salaryType"], job["salaryRange"]["start"], job["salaryRange"]["end"]), sections(responsibilities, requirements, labels))
    last = lambda name: cleanup_text(F.coalesce(F.try_element_at(F.filter(facts["dealls_sections"], lambda s: F.lower(s["label"]) == name.lower())["html"], F.lit(-1)), F.lit("")))
    dom = _ad(urls.canonical_url(url), facts["h1"], some(facts["dealls_company"], facts["h2"]), some(dealls_dom_salary(facts["leaves"]), F.lit("Negotiable")), sections(last(labels[0]), last(labels[1]), labels))
    return F.when(job.isNotNull(), own).otherwise(dom)


def dealls_listing_ads(facts: Column, url: Column) -> Column:
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    state = F.transform(dealls_listing(facts["next_data"], origin), lambda a: _ad(a["source_url"], a["title"], a["company"], a["salary"]))

    def card(c: Column) -> Column:
        good = lambda own: urls.is_detail_path("dealls", urls.url_path(c["href"])) & urls.is_detail_url("dealls", own)
        return let(urls.canonical_url(c["url"]), lambda own: _ad(F.when(good(own), own), some(c["title"], c["text"], own), F.lit(""), F.lit("Negotiable")))

    dom = F.filter(F.transform(facts["dealls_cards"], card), lambda a: a["source_url"].isNotNull())
    return _distinct(let(state, lambda s: F.when(F.size(s) > 0, s).otherwise(dom)))


def threads_caption(facts: Column) -> Column:
    seed = some(F.trim(meta(facts, "og:description")), F.trim(meta(facts, "twitter:description")))
    return captions.best_caption(seed, F.coalesce(facts["plaintexts"], F.array().cast("array<string>")))


def threads_ad(facts: Column, url: Column) -> Column:
    """The ad of a post; null without a caption."""
    told = lambda c, f: _ad(urls.canonical_threads_url(url, meta(facts, "og:url")), f["title"], f["company"], f["salary"], c)
    return let(threads_caption(facts), lambda c: F.when(c != "", let(captions.caption_fields(c), lambda f: told(c, f))))


Adapter = Callable[[DataFrame], DataFrame]
_OWN: dict[str, Adapter] = {}


def register_adapter(name: str, fn: Adapter) -> None:
    """A user's adapter: pages with facts and kind in, the same with a column `ads` (an array of ad structs) out."""
    _OWN[name] = fn


def unregister_adapter(name: str) -> None:
    _OWN.pop(name, None)


_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def _by_kind(detail: Column, listing: Column) -> Column:
    return F.when(F.col("kind") == "detail", detail).when(F.col("kind") == "listing", listing)


def _jobstreet(df: DataFrame) -> DataFrame:
    return df.withColumn("ads", _by_kind(F.array(jobstreet_detail(F.col("facts"), F.col("final_url"))), jobstreet_listing(F.col("facts"))))


def _glints(df: DataFrame) -> DataFrame:
    return df.withColumn("ads", _by_kind(F.array(glints_detail(F.col("facts"), F.col("final_url"))), F.slice(glints_listing(F.col("facts")), 1, 100)))


def _dealls(df: DataFrame) -> DataFrame:
    df = df.withColumn("_job", dealls_job(F.col("facts")["next_data"]))
    df = df.withColumn("_text1", text_with_breaks(F.col("_job.responsibilities"))).withColumn("_text2", text_with_breaks(F.col("_job.requirements")))
    return df.withColumn("ads", _by_kind(F.array(dealls_detail(F.col("facts"), F.col("final_url"), F.col("_job"), F.col("_text1"), F.col("_text2"))), dealls_listing_ads(F.col("facts"), F.col("final_url"))))


def _kalibrr(df: DataFrame) -> DataFrame:
    job = F.try_variant_get(F.try_parse_json(F.col("facts")["next_data"]), "$.props.pageProps.job", "variant")
    origin = F.regexp_extract(F.col("final_url"), _ORIGIN, 1)
    df = df.withColumn("_k", let(job, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), kalibrr_ad(v, origin))))
    df = df.withColumn("_text1", text_with_breaks(F.col("_k.description_html"))).withColumn("_text2", text_with_breaks(F.col("_k.qualifications_html")))
    text = sections(F.col("_text1"), F.col("_text2"), ("Deskripsi Pekerjaan", "Kualifikasi Minimum"))
    k = F.col("_k")
    ad = _ad(F.coalesce(k["source_url"], urls.canonical_url(F.col("final_url"))), k["title"], k["company"], k["salary"], text)
    return df.withColumn("ads", F.when((F.col("kind") == "detail") & k.isNotNull(), F.array(ad)))


def _threads(df: DataFrame) -> DataFrame:
    return df.withColumn("ads", F.array_compact(F.array(threads_ad(F.col("facts"), F.col("final_url")))))


def _static(df: DataFrame) -> DataFrame:
    return df.withColumn("ads", static_ads(F.col("facts"), F.col("final_url"), F.col("_links")))


def _unknown(df: DataFrame) -> DataFrame:
    return df.withColumn("ads", F.array().cast(_ADS))


_BOARDS: dict[str, Adapter] = {"jobstreet": _jobstreet, "glints": _glints, "dealls": _dealls, "kalibrr": _kalibrr, "threads": _threads, "static": _static}


def read_facts(pages: DataFrame, also: str | None = None) -> dict[str, DataFrame]:
    """Pages (requested_url, final_url, body, …) with `adapter` and `facts`, parted by adapter; '' holds those of adapters that are not known.

    The bodies are read once, each for its adapter, and the facts staged in a folder an adapter: what follows is one small plan an adapter, and only for those that have pages.
    """
    adapter = urls.route(F.col("requested_url"))
    if "adapter" in pages.columns:
        adapter = F.coalesce("adapter", adapter)
    names = [*_BOARDS, *(n for n in _OWN if n not in _BOARDS)]
    df = page_facts(pages.withColumn("adapter", adapter), adapter="adapter", also=also)
    board = F.coalesce(*[F.when(F.col("adapter") == n, k) for k, n in enumerate(names)], F.lit(-1))
    parts = staged_by(df, board)
    return {names[k] if k >= 0 else "": part for k, part in parts.items()}


def ads_of(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of parse_pages, from read_facts."""
    out = None
    for name, df in parts.items():
        links = job_links(F.col("facts")) if name in ("", "static") or name in _OWN else F.lit(None).cast("array<struct<href: string, title: string>>")
        df = df.withColumn("_links", links)
        df = df.withColumn("kind", page_kind(F.col("adapter"), F.col("requested_url"), F.col("final_url"), F.col("facts"), F.col("_links")))
        keep = [c for c in df.columns if c not in ("adapter", "facts", "_links", "kind")]
        df = _OWN[name](df.drop("_links")) if name in _OWN else _BOARDS.get(name, _unknown)(df)
        good = F.filter(F.coalesce("ads", F.array().cast(_ADS)), lambda a: (F.coalesce(a["title"], F.lit("")) != "") | F.lit(name == "threads"))
        df = df.withColumn("ads", F.when(F.col("facts")["error"].isNull(), good).otherwise(F.array().cast(_ADS)))
        error = F.when(F.size("ads") == 0, F.coalesce(F.col("facts")["error"], F.concat(F.lit("no job data extracted from "), F.col("final_url"))))
        rows = df.select(*keep, "adapter", "kind", next_page_url(F.col("facts")).alias("next_url"), error.alias("error"), F.posexplode_outer("ads").alias("pos", "ad"))
        rows = rows.select(*keep, "adapter", "kind", "next_url", "error", "pos", "ad.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def static_forms(parts: dict[str, DataFrame]) -> DataFrame:
    """(requested_url, title, company, salary, description) of every page as one of an unknown site, from read_facts(…, also="static")."""
    out = None
    for df in parts.values():
        ad = static_detail(F.col("facts"), F.col("final_url"))
        rows = df.where(F.col("facts")["error"].isNull()).select("requested_url", ad.alias("ad")).select("requested_url", "ad.title", "ad.company", "ad.salary", "ad.description")
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_pages(pages: DataFrame) -> DataFrame:
    """(…page columns…, adapter, kind, next_url, error, pos, ad fields) for every ad of every page, and one row with error for pages without."""
    return ads_of(read_facts(pages))


def fill_with(ads: DataFrame, extract: Callable[[str, list[str]], tuple[str, str, str]]) -> DataFrame:
    """A user's extractor (text, missing fields) -> (title, company, salary), called only for ads with an empty field; its errors change nothing."""
    from adloom.functions.prompts import missing_fields

    open_ = ads.select("source_url", "description", missing_fields(F.col("title"), F.col("company"), F.col("salary")).alias("missing")).where((F.size("missing") > 0) & (F.trim(F.coalesce("description", F.lit(""))) != ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, text, missing in zip(pdf["source_url"], pdf["description"], pdf["missing"], strict=True):
                try:
                    rows.append((url, *extract(text, list(missing))))
                except Exception:  # the extractor is the user's; its failure leaves the ad as it is
                    rows.append((url, None, None, None))
            yield pd.DataFrame(rows, columns=["source_url", "title", "company", "salary"])

    return fill_empty_fields(ads, open_.mapInPandas(run, "source_url string, title string, company string, salary string"))
