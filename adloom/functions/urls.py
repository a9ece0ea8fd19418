"""URLs as Columns. Host and path come from patterns: Spark's URL parser rejects addresses that boards do use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.columns import let

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

#: Fixed values: (adapter, how, needle) in order; the first that fits a lower-cased host wins.
ROUTES = (
    ("jobstreet", "contains", "jobstreet"), ("glints", "contains", "glints"), ("dealls", "contains", "dealls"), ("kalibrr", "contains", "kalibrr"),
    ("threads", "equals", "threads.com"), ("threads", "equals", "threads.net"),
)
#: Path patterns of ads on each board, and first segments that are no ads.
DETAIL = {
    "jobstreet": (r"(?i)^(?:/[a-z]{2})?/job/(\d+)/?$", ()),
    "glints": (r"(?i)^(?:/[a-z]{2}){0,2}/opportunities/jobs/([^/]+)/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/?$", ("explore", "bookmarked", "recommended", "id")),
    "dealls": (r"(?i)^/loker/([^/~]+)~([^/?#]+)/?$", ("saved", "applied")),
    "kalibrr": (r"(?i)^(?:/[a-z]{2}(?:-[a-z]{2})?)?/c/([^/]+)/jobs/(\d+)/([^/?#]+)/?$", ()),
}
#: Parts of a path that tell of a job on an unknown site.
JOB_NEEDLES = (
    "/job/", "/jobs/", "/position/", "/positions/", "/vacancy/", "/vacancies/",
    "/career/", "/careers/", "/opening/", "/openings/", "/role/", "/roles/",
)
#: Fixed value: the path of a post.
THREADS_POST = r"(?i)^/@([^/]+)/post/([^/]+)/?$"


def url_host(c: Column) -> Column:
    """Lower-cased host, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), HOST, 1))


def url_path(c: Column) -> Column:
    """Path of an absolute or relative address."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), PATH, 1)


def route(c: Column, rules: tuple[tuple[str, str, str], ...] = ROUTES, default: str = "static") -> Column:
    """The adapter of an address: the first rule that fits its host."""
    host = url_host(c)
    bare = F.regexp_replace(host, r"^www\.", "")
    test = {"contains": lambda n: host.contains(n), "equals": lambda n: bare == n, "starts": lambda n: host.startswith(n)}
    return reduce(lambda out, r: F.when(test[r[1]](r[2]), F.lit(r[0])).otherwise(out), reversed(rules), F.lit(default))


def is_detail_path(board: str, path: Column) -> Column:
    pattern, reserved = DETAIL[board]
    fits = path.rlike(pattern)
    return let(path, lambda p: p.rlike(pattern) & ~F.lower(F.regexp_extract(p, pattern, 1)).isin(*reserved)) if reserved else fits


def is_detail_url(board: str, c: Column) -> Column:
    """Is this the address of one ad on that board."""
    return is_detail_path(board, url_path(c))


def looks_like_job_path(path: Column, needles: tuple[str, ...] = JOB_NEEDLES) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles])


def canonical_url(c: Column) -> Column:
    """Without query, fragment and closing slashes; the `://` stays."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#][\s\S]*$", ""), r"(?<!:)(?<!:/)/+$", "")


def canonical_threads_url(page: Column, og: Column) -> Column:
    """The post's own address from og:url, else from the page's; else the page's without query and fragment."""
    def post(c: Column) -> Column:
        return let(F.trim(F.coalesce(c, F.lit(""))), found)

    def found(c: Column) -> Column:
        path = url_path(c)
        host = F.regexp_replace(url_host(c), r"^www\.", "")
        return F.when(host.isin("threads.com", "threads.net") & path.rlike(THREADS_POST), F.concat(
            F.lit("https://www.threads.com/@"), F.regexp_extract(path, THREADS_POST, 1), F.lit("/post/"), F.regexp_extract(path, THREADS_POST, 2)))

    return F.coalesce(post(og), post(page), F.regexp_replace(F.trim(page), r"[?#][\s\S]*$", ""))


def without_dots(segments: Column) -> Column:
    """The path of segments (the first empty, as of `/a/b`) with `.` and `..` steps taken; never above the root."""
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    taken = lambda x: F.concat(F.aggregate(x, F.array().cast("array<string>"), step), F.when(F.element_at(x, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    path = let(segments, lambda x: F.array_join(taken(x), "/"))
    return let(path, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def resolve_url(base: Column, href: Column) -> Column:
    """A link of a page as an absolute address, dot segments removed from relative ones."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    clean = F.regexp_replace(base, r"[?#][\s\S]*$", "")
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*([\s\S]*)$", 1)
    above = let(F.split(url_path(clean), "/"), lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))))
    # empty segments go where a relative path is put together
    inner = lambda x: F.concat(F.slice(x, 1, 1), F.filter(F.slice(x, F.lit(2), F.greatest(F.size(x) - 2, F.lit(0))), lambda s: s != ""), F.slice(x, F.greatest(F.size(x), F.lit(2)), F.lit(1)))
    joined = without_dots(let(F.concat(above, F.split(path, "/")), inner))
    return (F.when(href == "", base).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), href))
            .when(href.startswith("/"), F.concat(root, without_dots(F.split(path, "/")), rest)).when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#[\s\S]*$", ""), href))
            .when(href.startswith("?"), F.concat(clean, href)).otherwise(F.concat(root, joined, rest)))


def dealls_href(job_slug: Column, company_slug: Column) -> Column:
    """The path of an ad, '' if a part is missing."""
    j, c = F.trim(F.coalesce(job_slug, F.lit(""))), F.trim(F.coalesce(company_slug, F.lit("")))
    return F.when((j == "") | (c == ""), "").otherwise(F.concat(F.lit("/loker/"), j, F.lit("~"), c))


def kalibrr_href(company_code: Column, job_id: Column, slug: Column) -> Column:
    """The path of an ad, '' if a part is missing."""
    c, s = F.trim(F.coalesce(company_code, F.lit(""))), F.trim(F.coalesce(slug, F.lit("")))
    return F.when((c == "") | (s == "") | (F.coalesce(job_id, F.lit(0)) <= 0), "").otherwise(F.concat(F.lit("/id-ID/c/"), c, F.lit("/jobs/"), job_id.cast("string"), F.lit("/"), s))


def dealls_search(c: Column) -> Column:
    """The search term of a listing's address."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"^[^?#]*\?(?:[^#]*&)?searchJob=([^&#]*)", 1)
    return F.trim(F.coalesce(F.try_url_decode(found), F.lit("")))


def kalibrr_search(c: Column) -> Column:
    """The search term in a listing's path."""
    found = F.regexp_extract(url_path(c), r"(?i)^(?:/[a-z]{2}(?:-[a-z]{2})?)?/home/te/([^/?#]+)/?$", 1)
    return F.trim(F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found))


def dealls_api_url(search: Column, page: Column, base: str = "https://api.sejutacita.id", limit: int = 18) -> Column:
    """The address of a page of search results; parameters stand in the order of their names."""
    return F.concat(F.lit(f"{base}/v1/explore-job/job?boostTheBoostedJob=true&limit={limit}&page="), page.cast("string"), F.lit("&published=true&search="),
                    F.url_encode(search), F.lit("&sortBy=asc&sortParam=mostRelevant&status=active"))


def kalibrr_api_url(search: Column, offset: Column, base: str = "https://www.kalibrr.id", limit: int = 15) -> Column:
    return F.concat(F.lit(f"{base}/kjs/job_board/search?limit={limit}&offset="), offset.cast("string"), F.lit("&text="), F.url_encode(search))
