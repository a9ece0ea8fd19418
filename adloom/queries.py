"""Every operator over the given tables, and the same results as SQL. Inputs are projections of those tables, so that each query grows with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import captions, prompts, salary, text, urls
from adloom.operators import adapters, ingest, listing, review
from adloom.plans.crawl import page_frontier_new
from adloom.sources import payload, tables
from adloom.sources.html import page_facts, text_with_breaks
from adloom.streaming import target as store
from adloom.streaming import updates as chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table, spark, sf_dir), where table(name) reads a given table, under its name."""
    def take(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return take


_CANONICAL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@query(f"SELECT page_id, {_CANONICAL} AS canonical, {_HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def canonical_pages(t, spark, sf):
    u = F.col("url")
    return t("pages").select("page_id", urls.canonical_url(u).alias("canonical"), urls.url_host(u).alias("host"), urls.url_path(u).alias("path"))


@query(f"""
WITH c AS (SELECT page_id, {_CANONICAL} AS source_url, {_HOST} AS host FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY page_id) AS k FROM c)
SELECT host, count(*) AS new_pages, min(page_id) AS first_page FROM n WHERE k = 1 AND source_url NOT IN (SELECT source_url FROM c WHERE page_id % 3 = 0) GROUP BY host""")
def ingest_new_ads(t, spark, sf):
    pages = t("pages").select("page_id", "url")
    new = page_frontier_new(pages, pages.where("page_id % 3 = 0"))
    return new.groupBy(urls.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("new_pages"), F.min("page_id").alias("first_page"))


_RULES = (("blog", "starts", "blog."), ("mobile", "starts", "m."), ("web", "starts", "www."), ("org", "contains", "example.org"))


@query(f"""SELECT page_id, CASE WHEN h LIKE 'blog.%' THEN 'blog' WHEN h LIKE 'm.%' THEN 'mobile' WHEN h LIKE 'www.%' THEN 'web' WHEN h LIKE '%example.org%' THEN 'org' ELSE 'static' END AS adapter
FROM (SELECT page_id, {_HOST} AS h FROM pages)""")
def route_hosts(t, spark, sf):
    return t("pages").select("page_id", urls.route(F.col("url"), _RULES).alias("adapter"))


_NEEDLES = ("/th", "/an", "/er", "/d", "/la")
_LINKS = f"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || x.href AS href, x.title, x.i FROM (
    SELECT page_id, url, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'href': h[i], 'title': regexp_replace(trim(b[i]), '\\s+', ' ', 'g'), 'i': i}})) AS x
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS b FROM pages))),
l AS (SELECT page_id, href, CASE WHEN title = '' THEN href ELSE title END AS title, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS k, i FROM a
    WHERE {' OR '.join(f"contains(lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '{n}')" for n in _NEEDLES)})
"""


def _facts(t) -> DataFrame:
    return page_facts(t("pages").select("page_id", F.col("url").alias("final_url"), F.col("html").alias("body")))


@query(_LINKS + "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, href, title FROM l WHERE k = 1")
def page_links(t, spark, sf):
    return _facts(t).select("page_id", F.posexplode(adapters.job_links(F.col("facts"), _NEEDLES)).alias("pos", "link")).select("page_id", "pos", "link.href", "link.title")


@query(_LINKS + """SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'jobstreet' WHEN page_id % 5 = 2 THEN 'glints' WHEN page_id % 5 = 3 THEN 'threads' ELSE 'static' END AS adapter,
    CASE WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 2 = 0 THEN 'detail' ELSE 'listing' END WHEN page_id % 5 = 2 THEN 'listing' WHEN page_id % 5 = 3 OR count(l.href) < 3 THEN 'detail' ELSE 'listing' END AS kind
FROM pages LEFT JOIN (SELECT * FROM l WHERE k = 1) l USING (page_id) GROUP BY page_id""")
def page_kind(t, spark, sf):
    """By final address, by requested address, always a detail, by what the page holds."""
    k = F.col("page_id") % 5
    adapter = F.when(k == 1, "jobstreet").when(k == 2, "glints").when(k == 3, "threads").otherwise("static")
    final = F.when((k == 1) & (F.col("page_id") % 2 == 0), F.concat(F.lit("https://id.jobstreet.com/ID/job/"), "page_id")).when(k == 2, f"https://glints.com/opportunities/jobs/a/{'1' * 8}-2222-3333-4444-{'5' * 12}").otherwise(F.col("url"))
    df = page_facts(t("pages").select("page_id", F.col("url").alias("requested_url"), final.alias("final_url"), F.col("html").alias("body")))
    return df.select("page_id", adapter.alias("adapter"), adapters.page_kind(adapter, F.col("requested_url"), F.col("final_url"), F.col("facts"), adapters.job_links(F.col("facts"), _NEEDLES)).alias("kind"))


_STRIP = r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"


@query(f"""SELECT page_id, {_STRIP.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS h1, {_STRIP.format("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title FROM pages""")
def page_headline(t, spark, sf):
    return _facts(t).select("page_id", "facts.h1", "facts.title")


_PAY_RE = salary.SALARY_TEXT.replace("'", "''")


@query(f"""
WITH x AS (SELECT page_id, url, {_STRIP.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS title, {_STRIP.format("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} AS article,
    {_STRIP.format("regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '<!--.*?-->', '', 'g')")} AS body FROM pages),
d AS (SELECT *, CASE WHEN strlen(article) >= 40 THEN article WHEN strlen(body) >= 40 THEN body ELSE '' END AS description FROM x)
SELECT page_id, url AS source_url, CASE WHEN title = '' THEN url ELSE title END AS title, '' AS company, 'static' AS adapter, 'detail' AS kind,
    trim(regexp_replace(coalesce(nullif(regexp_extract(title, '(?i){_PAY_RE}', 0), ''), regexp_extract(description, '(?i){_PAY_RE}', 0)), '\\s+', ' ', 'g')) AS salary, description FROM d""")
def static_pages(t, spark, sf):
    """Whole ads from pages of unknown sites."""
    pages = t("pages").select("page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.col("html").alias("body"), F.lit("static").alias("adapter"))
    return adapters.parse_pages(pages).select("page_id", "source_url", "title", "company", "adapter", "kind", "salary", "description")


_MARK = "regexp_replace(regexp_replace(regexp_replace(a, '<br>', chr(10), 'g'), '</?(?:h1|p|ul|div)>', chr(1), 'g'), '<li>', chr(1) || '• ', 'g')"
_LINES = f"regexp_replace(regexp_replace(regexp_replace({_MARK}, '</li>', chr(1), 'g'), '<[^>]*>', '', 'g'), '\x01+', chr(1), 'g')"
_BROKEN = f"replace(regexp_replace(replace({_LINES}, chr(10) || chr(1), chr(10)), '^\x01', ''), chr(1), chr(10))"


@query(rf"""
WITH x AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) || '<ul><li>first ' || page_id || '</li><li>last</li></ul>end' AS a FROM pages),
t AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace({_BROKEN}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&copy;', '©'), '&amp;?', '&', 'g') AS t FROM x)
SELECT page_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda y: trim(regexp_replace(y, '\s+', ' ', 'g'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text FROM t""")
def page_breaks(t, spark, sf):
    """Articles and a list after each, with breaks."""
    article = F.concat(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), F.lit("<ul><li>first "), F.col("page_id").cast("string"), F.lit("</li><li>last</li></ul>end"))
    return t("pages").select("page_id", text_with_breaks(article).alias("text"))


_CARDS = "SELECT l_suppkey AS source_id, {page} AS page_no, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos, 'u' || l_partkey AS source_url FROM lineitem"


def _cards(t, page: Column) -> DataFrame:
    return t("lineitem").select(F.col("l_suppkey").alias("source_id"), page.cast("int").alias("page_no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("u"), F.col("l_partkey")).alias("source_url"))


def _prefix_sql(page: str, ends: str, good: str, last: str) -> str:
    return f"""
WITH c AS ({_CARDS.format(page=page)}),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_url ORDER BY page_no, pos) AS k FROM c) WHERE k = 1),
e AS ({ends}),
p AS (SELECT e.*, row_number() OVER (PARTITION BY source_id ORDER BY page_no) AS i, first_value(total) OVER (PARTITION BY source_id ORDER BY page_no) AS first_total,
    (SELECT count(*) FROM n WHERE n.source_id = e.source_id AND n.page_no = e.page_no) AS added FROM e),
w AS (SELECT *, CASE WHEN NOT ({good}) OR added = 0 THEN 1 ELSE 0 END AS bad, CASE WHEN {last} THEN 1 ELSE 0 END AS last FROM p),
s AS (SELECT *, max(bad) OVER (PARTITION BY source_id ORDER BY page_no) AS stopped, coalesce(max(last) OVER (PARTITION BY source_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM w),
r AS (SELECT n.source_id, n.page_no, n.pos, n.source_url, row_number() OVER (PARTITION BY n.source_id ORDER BY n.page_no, n.pos, n.source_url) AS k FROM n JOIN s USING (source_id, page_no) WHERE stopped = 0 AND ended = 0)
SELECT source_id, page_no, pos, source_url FROM r WHERE k <= 100"""


_PAGES = "SELECT l_suppkey AS source_id, CAST({page} AS INTEGER) AS page_no, {cols} FROM lineitem GROUP BY 1, 2"
_P1, _P2 = "CAST(l_orderkey // 8 % 9 + 1 AS INTEGER)", "CAST(l_orderkey // 8 % 9 * 15 AS INTEGER)"


@query(_prefix_sql(_P1, _PAGES.format(page=_P1, cols="max(l_quantity) < 50 AS has_next, 0 AS total"), "page_no = i", "NOT has_next"))
def listing_link(t, spark, sf):
    cards = _cards(t, F.expr("l_orderkey div 8 % 9 + 1"))
    pages = t("lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.expr("l_orderkey div 8 % 9 + 1").cast("int").alias("page_no")).agg((F.max("l_quantity") < 50).alias("has_next"))
    return listing.listing_prefix(cards, pages, "link")


@query(_prefix_sql(_P1, _PAGES.format(page=_P1, cols="min(l_linenumber) = 1 AS ok, CAST(l_suppkey % 7 + 2 AS INTEGER) AS total"), "page_no = i AND ok", "page_no > 1 AND page_no >= total"))
def listing_pages(t, spark, sf):
    cards = _cards(t, F.expr("l_orderkey div 8 % 9 + 1"))
    pages = t("lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.expr("l_orderkey div 8 % 9 + 1").cast("int").alias("page_no")).agg(
        (F.min("l_linenumber") == 1).alias("ok"), (F.first(F.col("l_suppkey")) % 7 + 2).cast("int").alias("total_pages"))
    return listing.listing_prefix(cards, pages, "pages")


@query(_prefix_sql(_P2, _PAGES.format(page=_P2, cols="max(l_quantity) > 5 AS ok, CAST(l_suppkey % 90 + min(l_linenumber) AS INTEGER) AS total"), "page_no = (i - 1) * 15 AND (page_no = 0 OR page_no < first_total) AND ok", "false"))
def listing_offset(t, spark, sf):
    page = F.expr("l_orderkey div 8 % 9 * 15")
    pages = t("lineitem").groupBy(F.col("l_suppkey").alias("source_id"), page.cast("int").alias("page_no")).agg(
        (F.max("l_quantity") > 5).alias("ok"), (F.first(F.col("l_suppkey")) % 90 + F.min("l_linenumber")).cast("int").alias("count"))
    return listing.listing_prefix(_cards(t, page), pages, "offset")


@query("""
SELECT o_custkey AS source_id, coalesce(d.url, 'o' || o_orderkey) AS source_url, coalesce(d.title, o_orderpriority) AS title, CASE WHEN d.url IS NULL THEN o_orderstatus ELSE '' END AS company
FROM orders LEFT JOIN (SELECT l_orderkey, 'd' || l_partkey AS url, l_returnflag || l_linestatus AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY 'd' || l_partkey, l_returnflag || l_linestatus) AS k
    FROM lineitem WHERE l_linenumber = 1) d ON o_orderkey = l_orderkey AND k = 1""")
def enrich_details(t, spark, sf):
    empty = F.lit("")
    stubs = t("orders").select(F.col("o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("source_url"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"), empty.alias("salary"), empty.alias("description"))
    details = t("lineitem").where("l_linenumber = 1").select(F.concat(F.lit("o"), "l_orderkey").alias("requested_url"), F.concat(F.lit("d"), "l_partkey").alias("source_url"),
                                                            F.concat("l_returnflag", "l_linestatus").alias("title"), empty.alias("company"), empty.alias("salary"), empty.alias("description"))
    return ingest.enrich(stubs, details).select("source_id", "source_url", "title", "company")


_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'new' WHEN 'F' THEN 'applied' ELSE 'ignored' END"


def _ads(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "new").when(F.col("o_orderstatus") == "F", "applied").otherwise("ignored")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.concat(F.lit("http://ads.example/"), "o_orderkey").alias("source_url"),
                              F.col("o_orderpriority").alias("title"), status.alias("status"), F.col("o_orderdate").alias("scraped_at"))


@query(f"""SELECT id, source_id, status, scraped_at, coalesce(c_name, '') AS source_name FROM (
    SELECT o_orderkey AS id, o_custkey AS source_id, {_STATUS} AS status, o_orderdate AS scraped_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100)
LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = source_id""")
def list_newest(t, spark, sf):
    names = t("customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return review.list_ads(_ads(t), names, "applied", 50, 100).select("id", "source_id", "status", "scraped_at", "source_name")


@query(f"SELECT coalesce(s, 'all') AS status, count(*) AS n FROM (SELECT {_STATUS} AS s FROM orders) GROUP BY ROLLUP (s)")
def status_counts(t, spark, sf):
    return review.status_counts(_ads(t))


@query(f"""SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages, greatest(1, least(1000000, CAST(ceil(count(*) / 50) AS BIGINT))) AS page FROM (SELECT {_STATUS} AS s FROM orders) WHERE s = 'new'""")
def page_info(t, spark, sf):
    return review.page_info(_ads(t), "new", 1_000_000)


@query(f"""WITH c AS (SELECT l_orderkey AS id, arg_max(CASE l_linenumber % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' ELSE 'ignored' END, l_linenumber) AS status FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1)
SELECT o_orderkey AS id, coalesce(c.status, {_STATUS}) AS status FROM orders LEFT JOIN c ON c.id = o_orderkey""")
def bulk_status(t, spark, sf):
    """The last allowed change of each ad counts."""
    n = F.col("l_linenumber")
    changes = t("lineitem").where("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("id"), F.when(n % 3 == 0, "applied").when(n % 3 == 1, "rejected").otherwise("ignored").alias("status"), n.cast("long").alias("at"))
    odd = _ads(t).where("id % 5 = 0").select("id", F.lit("odd").alias("status"), F.lit(100).cast("long").alias("at"))
    return review.apply_status(_ads(t), changes.unionByName(odd), ("at",)).select("id", "status")


@query("""SELECT 'ad' AS kind, o_orderkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 2
UNION ALL SELECT 'letter', l_orderkey, count(*) FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 2""")
def delete_cascade(t, spark, sf):
    letters = t("lineitem").select(F.col("l_orderkey").alias("job_ad_id"), F.col("l_linenumber").alias("id"))
    everyone = t("orders").select(F.col("o_orderkey").alias("id")).union(t("lineitem").select("l_orderkey")).where("id % 10 = 3")
    ads, left = review.delete_ads(_ads(t), letters, everyone)
    return ads.select(F.lit("ad").alias("kind"), "id").union(left.select(F.lit("letter"), "job_ad_id")).groupBy("kind", "id").agg(F.count("*").alias("n"))


@query("""SELECT 'labels' AS child, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)
UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def orphans(t, spark, sf):
    a = review.orphans(t("labels"), t("documents").where("n_chars > 500"), "doc_id", "doc_id")
    b = review.orphans(t("orders"), t("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey")
    return a.select(F.lit("labels").alias("child"), F.col("doc_id").alias("id")).union(b.select(F.lit("orders"), "o_orderkey"))


@query("""SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'status' END, CASE WHEN o_orderkey % 11 = 0 THEN 'source_url' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'title' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def violations(t, spark, sf):
    bad = _ads(t).withColumn("status", F.when(F.col("status") == "ignored", "open").otherwise(F.col("status"))).withColumn("source_url", F.when(F.col("id") % 11 == 0, " ").otherwise(F.col("source_url")))
    return review.violations(bad.withColumn("title", F.when(F.col("title") != "5-LOW", F.col("title"))))


@query("SELECT conv_id AS job_ad_id, turn AS id, text AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'assistant') WHERE k = 1")
def latest_letter(t, spark, sf):
    letters = t("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("job_ad_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.col("text").alias("content"))
    return review.latest_letter(letters).select("job_ad_id", "id", "content")


@query("SELECT conv_id AS job_ad_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def letters_of(t, spark, sf):
    """Letters of the conversations that have a system turn."""
    letters = t("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("job_ad_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"))
    ads = t("conversations").where("role = 'system'").select(F.col("conv_id").alias("id"))
    return review.letter_ranks(review.letters_of(ads, letters)).select("job_ad_id", "id", F.col("rank").cast("long"))


@query("""SELECT key, coalesce(arg_max(value, ord), '') AS value FROM (SELECT event_type AS key, 'v' || event_id AS value, event_id AS ord FROM events
UNION ALL SELECT n_name, 'base', -1 FROM nation) GROUP BY key""")
def profile_upsert(t, spark, sf):
    base = t("nation").select(F.col("n_name").alias("key"), F.lit("base").alias("value"), F.lit(-1).cast("long").alias("at")).union(
        t("events").select("event_type", F.lit("old"), F.lit(-1).cast("long")).distinct())
    changes = t("events").select(F.col("event_type").alias("key"), F.concat(F.lit("v"), "event_id").alias("value"), F.col("event_id").alias("at"))
    return ingest.upsert(base, changes, ["key"], ["at"]).select("key", "value")


@query("SELECT o_orderkey, 500 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def assign_ids(t, spark, sf):
    return ingest.assign_ids(t("orders").select("o_orderkey"), 500, ["o_orderkey"]).select("o_orderkey", "id")


_IDR = "'Rp' || replace(format('{{:,}}', {}), ',', '.')"
_AMOUNT = "CAST(floor(p_retailprice) AS BIGINT) * 1000"


@query(f"""SELECT p_partkey, {_IDR.format(_AMOUNT)} AS idr,
CASE WHEN p_size % 10 = 0 THEN 'Unpaid' WHEN p_size % 10 = 1 THEN 'Negotiable' WHEN p_size % 10 = 2 THEN {_IDR.format(_AMOUNT)} ELSE {_IDR.format(_AMOUNT)} || ' – ' || {_IDR.format(f'({_AMOUNT} + 500000)')} END AS dealls,
CASE WHEN p_size % 7 = 0 OR p_size % 10 = 1 THEN 'Gaji Tidak Diumumkan' ELSE CASE WHEN p_size % 10 = 2 THEN {_IDR.format(_AMOUNT)} ELSE {_IDR.format(_AMOUNT)} || ' – ' || {_IDR.format(f'({_AMOUNT} + 500000)')} END
|| CASE WHEN p_size % 3 = 0 THEN ' / bulan' WHEN p_size % 3 = 1 THEN ' / tahun' ELSE '' END END AS kalibrr FROM part""")
def format_salary(t, spark, sf):
    low, k = F.floor("p_retailprice").cast("long") * 1000, F.col("p_size") % 10
    low = F.when(k == 1, F.lit(0)).otherwise(low)
    high = F.when(k == 1, F.lit(None).cast("long")).when(k == 2, low).otherwise(low + 500000)
    period = F.when(F.col("p_size") % 3 == 0, " Month").when(F.col("p_size") % 3 == 1, "yearly")
    return t("part").select("p_partkey", salary.format_idr(-F.floor("p_retailprice").cast("long") * 1000).alias("idr"),
                            salary.dealls_salary(F.when(k == 0, "UNPAID"), low, high).alias("dealls"),
                            salary.kalibrr_salary(F.col("p_size") % 7 != 0, low, high, period).alias("kalibrr"))


_PAY = "p_name || '. Gaji: Rp ' || CAST(p_size AS VARCHAR) || '.000 - Rp ' || CAST(p_size * 2 AS VARCHAR) || '.000 per month ' || p_type"
_RE = salary.SALARY_TEXT.replace("'", "''")


@query(f"""SELECT p_partkey, regexp_replace(trim(regexp_extract(x, '(?i){_RE}', 0)), '\\s+', ' ', 'g') AS found, regexp_matches(lower(p_name), 'salary|compensation|gaji|negotiable') OR regexp_matches(p_name, '(?i){_RE}') AS named
FROM (SELECT *, {_PAY} AS x FROM part)""")
def find_salary(t, spark, sf):
    s = F.col("p_size")
    x = F.concat("p_name", F.lit(". Gaji: Rp "), s.cast("string"), F.lit(".000 - Rp "), (s * 2).cast("string"), F.lit(".000 per month "), "p_type")
    return t("part").select("p_partkey", salary.truncate_salary(text.collapse_ws(salary.find_salary(x))).alias("found"), salary.looks_like_salary(F.col("p_name")).alias("named"))


_MESSAGES = "SELECT conv_id * 100 + turn AS update_id, c.text || ' ' || p.url || ', (' || p.url || '). ' || replace(p.url, 'example', 'glints') || ' x' AS text, conv_id % 4 AS chat FROM conversations c JOIN pages p ON p.page_id = c.conv_id"
_FOUND = f"""WITH m AS ({_MESSAGES}), w AS (SELECT * FROM m WHERE chat <> 1),
f AS (SELECT update_id, list_transform(regexp_extract_all(text, 'https?://[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,);\\]]+$', '')) AS u FROM w),
e AS (SELECT update_id, unnest(u) AS url, generate_subscripts(u, 1) AS i FROM f),
l AS (SELECT update_id, url, CAST(row_number() OVER (PARTITION BY update_id ORDER BY i) - 1 AS INTEGER) AS pos FROM (SELECT update_id, url, min(i) AS i FROM e GROUP BY ALL)),
r AS (SELECT update_id, url, len(url) % 3 <> 0 AS ok, len(url) % 2 = 0 AS inserted FROM l)
"""


def _messages(t) -> DataFrame:
    c, p = t("conversations"), t("pages").select("page_id", "url")
    body = F.concat("text", F.lit(" "), "url", F.lit(", ("), "url", F.lit("). "), F.replace(F.col("url"), F.lit("example"), F.lit("glints")), F.lit(" x"))
    chat_id = F.when(F.col("conv_id") % 4 == 1, 1).otherwise(0).cast("long")
    return c.join(p, c["conv_id"] == p["page_id"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("update_id"),
                                                          F.struct(F.col("turn").alias("message_id"), body.alias("text"), F.struct(chat_id.alias("id")).alias("chat")).alias("message"))


def _results(links: DataFrame) -> DataFrame:
    return links.select("update_id", "url", (F.length("url") % 3 != 0).alias("ok"), (F.length("url") % 2 == 0).alias("inserted"))


@query(_FOUND + f"SELECT update_id, pos, url, CASE WHEN {_HOST} LIKE '%glints%' THEN 'glints' ELSE 'static' END AS adapter FROM l")
def message_links(t, spark, sf):
    return chat.message_links(chat.wanted_messages(_messages(t), 0))


@query(_FOUND + "SELECT update_id, CASE WHEN bool_or(ok) THEN 'success' WHEN bool_or(NOT ok) THEN 'failure' ELSE 'none' END AS outcome FROM w LEFT JOIN r USING (update_id) GROUP BY update_id")
def message_outcome(t, spark, sf):
    wanted = chat.wanted_messages(_messages(t), 0)
    return chat.message_outcome(wanted, _results(chat.message_links(wanted))).select("update_id", "outcome")


@query(_FOUND + "SELECT (SELECT count(*) FROM w) AS messages_checked, count(*) AS links_found, count(*) FILTER (WHERE ok AND inserted) AS links_scraped, count(*) FILTER (WHERE NOT ok) AS errors FROM r")
def check_summary(t, spark, sf):
    wanted = chat.wanted_messages(_messages(t), 0)
    return chat.check_summary(wanted, _results(chat.message_links(wanted)))


@query("SELECT greatest(max(event_id), 5) AS last_update_id FROM events")
def high_water_mark(t, spark, sf):
    return chat.high_water_mark(t("events").select(F.col("event_id").alias("update_id")), 5)


@query("""SELECT 'http://' || event_type || '.example/' || user_id AS source_url, min(event_id) AS pos FROM events WHERE value > 1 GROUP BY 1""")
def update_stream(t, spark, sf):
    """Events as a stream of ads, ingested by micro-batches into a table."""
    events = spark.readStream.schema(t("events").schema).parquet(f"{sf}/[e]vents.parquet")  # a pattern: the stream source takes folders and patterns only
    source = F.concat(F.lit("http://"), "event_type", F.lit(".example/"), "user_id")
    ads = events.where("value > 1").select(source.alias("source_url"), F.col("event_id").alias("pos"))
    top = tables.new_folder(spark)
    chat.stream_ingest(ads, f"{top}/ads", f"{top}/progress").awaitTermination()
    return store.read_rows(spark, f"{top}/ads", "source_url string, pos long")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://dealls.com/loker/job-' || s_suppkey || '~co-' || s_nationkey END AS source_url, CASE WHEN s_suppkey % 4 <> 0 THEN trim(s_name) END AS title,
CASE WHEN s_suppkey % 4 <> 0 THEN 'Nation ' || s_nationkey END AS company, s_suppkey % 5 <> 0 AS ok FROM supplier WHERE s_suppkey % 5 <> 0""")
def dealls_payload(t, spark, sf):
    job = F.struct(F.concat(F.lit("  "), "s_name").alias("role"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("job-"), "s_suppkey")).alias("slug"), F.struct(F.concat(F.lit("Nation  "), "s_nationkey").alias("name"), F.concat(F.lit("co-"), "s_nationkey").alias("slug")).alias("company"))
    body = F.to_json(F.struct(F.when(F.col("s_suppkey") % 5 == 0, 500).otherwise(200).alias("code"), F.struct(F.array(job).alias("docs"), F.lit(3).alias("totalPages")).alias("data")))
    pages = payload.dealls_api_ads(t("supplier").select("s_suppkey", body.alias("body"))).where("ok")
    return pages.select("s_suppkey", "ok", F.explode_outer("ads").alias("a")).select("s_suppkey", "a.source_url", "a.title", "a.company", "ok")


@query(f"""SELECT p_partkey, 'https://www.kalibrr.id/id-ID/c/' || lower(replace(p_brand, '#', '-')) || '/jobs/' || (p_partkey + 1) || '/s' AS source_url, p_name AS title, p_brand AS company,
{_IDR.format(_AMOUNT)} || ' / bulan' AS salary FROM part WHERE floor(p_retailprice) > 0""")
def kalibrr_payload(t, spark, sf):
    code = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))
    snake = F.to_json(F.struct((F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"), F.lit("s").alias("slug"), (F.floor("p_retailprice").cast("double") * 1000 + 0.25).alias("base_salary"), F.lit("month").alias("salary_interval"), F.struct(code.alias("code"), F.col("p_brand").alias("name")).alias("company")))
    camel = F.to_json(F.struct((F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"), F.lit("s").alias("slug"), (F.floor("p_retailprice").cast("long") * 1000).alias("baseSalary"), F.lit("monthly").alias("salaryInterval"), F.col("p_brand").alias("companyName"), F.struct(code.alias("code")).alias("companyInfo")))
    body = F.concat(F.lit('{"count": 1, "jobs": ['), F.when(F.col("p_partkey") % 2 == 0, snake).otherwise(camel), F.lit("]}"))
    ads = payload.kalibrr_api_ads(t("part").where("floor(p_retailprice) > 0").select("p_partkey", body.alias("body")))
    return ads.select("p_partkey", F.explode("ads").alias("a")).select("p_partkey", "a.source_url", "a.title", "a.company", "a.salary")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def event_props(t, spark, sf):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Tram Driver ' || s_suppkey END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Nation' || s_nationkey || ' Lantern Pte Ltd' ELSE '' END AS company,
CASE WHEN s_suppkey % 5 = 0 THEN 'Gaji: UMR' ELSE 'SGD ' || s_nationkey || '/month' END AS salary FROM supplier""")
def caption_fields(t, spark, sf):
    k = F.col("s_suppkey")
    caption = F.concat(F.when(k % 3 == 0, "Hello there").otherwise(F.concat(F.lit("We’re hiring | Tram Driver "), k.cast("string"), F.lit(" 📍 town"))), F.lit("\n\n"),
                       F.when(k % 2 == 0, F.concat(F.lit("Join Nation"), "s_nationkey", F.lit(" Lantern Pte Ltd in town\n"))).otherwise(""), F.when(k % 5 == 0, "Gaji: UMR\n").otherwise(F.concat(F.lit("SGD "), "s_nationkey", F.lit("/month\n"))))
    return t("supplier").select("s_suppkey", captions.caption_fields(caption).alias("f")).select("s_suppkey", "f.*")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Answer ' || o_orderkey END ELSE o_orderpriority END AS title FROM orders""")
def fill_fields(t, spark, sf):
    k = F.col("o_orderkey")
    ads = t("orders").select(k.alias("id"), k.cast("string").alias("source_url"), F.when(k % 2 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"), F.lit("C").alias("company"), F.lit("s").alias("salary"))
    raw = t("orders").select(k.cast("string").alias("source_url"), prompts.decode_fields(F.when(k % 3 == 0, "no json").otherwise(F.concat(F.lit('```json\n{"title": " Answer '), k.cast("string"), F.lit('"}\n```')))).alias("f"))
    return ingest.fill_empty_fields(ads, raw.select("source_url", "f.*")).select("id", F.trim("title").alias("title"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]+', ' ', 'g')) AS flat, md5(regexp_replace(regexp_replace(array_to_string(list_transform(
string_split(regexp_replace(replace(text, chr(160), ' '), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS clean_md5 FROM documents""")
def clean_text(t, spark, sf):
    c = F.col("text")
    return t("documents").select("doc_id", text.collapse_ws(c).alias("flat"), F.md5(text.cleanup_text(c)).alias("clean_md5"))


@query("""SELECT doc_id, 'Candidate profile:' || chr(10) || '- full_name: Ann' || chr(10) || '- skills: Spark' || chr(10) || '- hobby: chess' || chr(10) || chr(10) || 'Job:' || chr(10) || 'Title: ' || coalesce(source, '') || chr(10) || 'Company: ' || coalesce(lang, '')
|| chr(10) || 'Description:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Write a tailored cover letter.' AS prompt FROM documents""")
def prompt_rows(t, spark, sf):
    pairs = {"full_name": " Ann ", "skills": "Spark", "summary": " ", "hobby": "chess", "signature": "A."}
    profile = tables.profile_map(t("region").limit(1).select(F.explode(F.create_map(*[F.lit(x) for p in pairs.items() for x in p])).alias("key", "value")))
    return review.prompt_rows(t("documents"), profile).select("doc_id", prompts.cover_letter_prompt(F.col("profile"), F.col("source"), F.col("lang"), F.col("text")).alias("prompt"))


@query("""WITH r AS (SELECT o_orderdate >= TIMESTAMP '1995-01-01' AS late, o_custkey AS source_id, o_orderstatus AS s FROM orders)
SELECT CASE WHEN late THEN 'late' ELSE 'early' END AS run, source_id, CASE WHEN source_id IS NULL THEN 'run' ELSE 'source' END AS level, count(DISTINCT src) AS sources, CAST(sum(s = 'P') AS BIGINT) AS new_ads, CAST(sum(s = 'F') AS BIGINT) AS skipped, CAST(sum(s = 'O') AS BIGINT) AS errors
FROM (SELECT *, source_id AS src FROM r) GROUP BY GROUPING SETS ((late, source_id), (late))""")
def crawl_summary(t, spark, sf):
    run = F.when(F.col("o_orderdate") >= "1995-01-01", "late").otherwise("early")
    outcome = F.when(F.col("o_orderstatus") == "P", "new").when(F.col("o_orderstatus") == "F", "skipped").otherwise("error")
    return ingest.crawl_summary(t("orders").select(run.alias("run"), F.col("o_custkey").alias("source_id"), outcome.alias("outcome")))


@query("""SELECT s_suppkey AS source_id, CAST(p AS INTEGER) AS page_no, CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.kalibrr.id/kjs/job_board/search?limit=15&offset=' || ((p - 1) * 15) || '&text=' || s_nationkey
WHEN p = 1 THEN 'https://dealls.com/?searchJob=' || s_nationkey ELSE 'https://api.sejutacita.id/v1/explore-job/job?boostTheBoostedJob=true&limit=18&page=' || p || '&published=true&search=' || s_nationkey || '&sortBy=asc&sortParam=mostRelevant&status=active' END AS page_url
FROM supplier, range(1, 5) r(p)""")
def frontier(t, spark, sf):
    even = F.col("s_suppkey") % 2 == 0
    url = F.when(even, F.concat(F.lit("https://www.kalibrr.id/id-ID/home/te/"), "s_nationkey")).otherwise(F.concat(F.lit("https://dealls.com/?searchJob="), "s_nationkey"))
    return tables.frontier(t("supplier").select(F.col("s_suppkey").alias("id"), url.alias("url"), F.when(even, "kalibrr").otherwise("dealls").alias("adapter")), 4)


@query("""SELECT s_suppkey AS id, CASE s_nationkey % 5 WHEN 0 THEN 'skip' WHEN 1 THEN 'error' ELSE 'crawl' END AS action FROM supplier WHERE s_acctbal > 0""")
def crawl_plan(t, spark, sf):
    adapter = F.element_at(F.array(*map(F.lit, ("telegram", "who", "static", "glints", "dealls"))), (F.col("s_nationkey") % 5 + 1).cast("int"))
    return ingest.crawl_plan(t("supplier").select(F.col("s_suppkey").alias("id"), adapter.alias("adapter"), (F.col("s_acctbal") > 0).alias("enabled"))).select("id", "action")


@query("""WITH c AS (SELECT 'r' || l_orderkey AS requested_url, CASE WHEN l_linenumber = 3 THEN 'r' || l_orderkey ELSE 'u' || l_partkey END AS source_url, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS description, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY source_url = requested_url DESC, pos) AS k FROM c)
SELECT requested_url, CASE WHEN source_url <> requested_url AND description = '' THEN requested_url ELSE source_url END AS source_url, CASE WHEN source_url <> requested_url AND description = '' THEN 'static' ELSE description END AS description FROM p WHERE k = 1""")
def pick_requested(t, spark, sf):
    own, empty = F.concat(F.lit("r"), "l_orderkey"), F.lit("")
    c = t("lineitem").select(own.alias("requested_url"), F.when(F.col("l_linenumber") == 3, own).otherwise(F.concat(F.lit("u"), "l_partkey")).alias("source_url"), empty.alias("title"), empty.alias("company"), empty.alias("salary"),
                             F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("description"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"))
    static = t("lineitem").select(own.alias("requested_url")).distinct().select("requested_url", empty.alias("title"), empty.alias("company"), empty.alias("salary"), F.lit("static").alias("description"))
    return ingest.pick_requested(c, static).select("requested_url", "source_url", "description")
