"""Changes of stored tables, users' adapters and extractors, and rules at their limits, over the given tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.board_queries import filled
from adloom.functions import salary, urls
from adloom.operators import adapters
from adloom.queries import _STATUS, _ads, query
from adloom.sources import stored, tables

_ADS = "id bigint, status string"


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS status, CAST(1 AS BIGINT) AS times FROM events")
def ads_rerun(t, spark, sf):
    """Two runs that append ads, the second done again with other rows: the last time counts."""
    top, empty = tables.new_folder(spark), F.lit("")
    k = F.col("event_id")
    ads = t("events").select(k.alias("id"), F.col("user_id").alias("source_id"), F.concat(F.lit("u"), k.cast("string")).alias("source_url"), empty.alias("title"), empty.alias("company"), empty.alias("salary"), empty.alias("description"),
                             F.col("ts").alias("posted_at"), F.col("ts").alias("scraped_at"), F.when(k % 2 == 0, "").otherwise(F.col("event_type")).alias("status"))
    tables.write_ads(ads.where("id % 2 = 0"), top, run="even")
    tables.write_ads(ads.where("id % 2 = 1").withColumn("scraped_at", F.lit("2020-01-01").cast("timestamp")), top, run="odd")
    tables.write_ads(ads.where("id % 2 = 1"), top, run="odd")
    return tables.read_ads(spark, top).groupBy("id", "status").agg(F.count("*").alias("times"))


@query(f"""WITH c AS (SELECT l_orderkey AS id, arg_max(CASE l_linenumber % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' ELSE 'ignored' END, l_linenumber) AS status FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1)
SELECT o_orderkey AS id, coalesce(c.status, {_STATUS}) AS status FROM orders LEFT JOIN c ON c.id = o_orderkey""")
def stored_status(t, spark, sf):
    """Statuses changed in a stored table: only parts with changed ids are rewritten."""
    top, n = tables.new_folder(spark), F.col("l_linenumber")
    stored.create(_ads(t).select("id", "status"), top, "id")
    changes = t("lineitem").where("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("id"), F.when(n % 3 == 0, "applied").when(n % 3 == 1, "rejected").otherwise("ignored").alias("status"), n.cast("long").alias("at"))
    stored.set_status(spark, top, _ADS, changes, ("at",))
    return stored.read(spark, top, _ADS)


@query("""SELECT 'ad' AS kind, o_orderkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 2
UNION ALL SELECT 'letter', l_orderkey, count(*) FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 2""")
def stored_delete(t, spark, sf):
    """Ads deleted from a stored table, with their letters in another."""
    ads, letters = tables.new_folder(spark), tables.new_folder(spark)
    stored.create(_ads(t).select("id", "status"), ads, "id")
    stored.create(t("lineitem").select(F.col("l_orderkey").alias("job_ad_id"), F.col("l_linenumber").cast("long").alias("id")), letters, "job_ad_id")
    ids = t("orders").select(F.col("o_orderkey").alias("id")).union(t("lineitem").select("l_orderkey")).where("id % 10 = 3")
    stored.delete(spark, (ads, _ADS), (letters, "job_ad_id bigint, id bigint"), ids)
    rows = stored.read(spark, ads, _ADS).select(F.lit("ad").alias("kind"), "id").union(stored.read(spark, letters, "job_ad_id bigint, id bigint").select(F.lit("letter"), "job_ad_id"))
    return rows.groupBy("kind", "id").agg(F.count("*").alias("n"))


@query("""SELECT key, arg_max(value, ord) AS value FROM (SELECT user_id AS key, 'v' || event_id AS value, event_id AS ord FROM events WHERE event_id % 3 = 0
UNION ALL SELECT c_custkey, 'base', -1 FROM customer) GROUP BY key""")
def stored_upsert(t, spark, sf):
    """A stored table with its last changes put in."""
    top, ddl = tables.new_folder(spark), "key bigint, value string, at bigint"
    stored.create(t("customer").select(F.col("c_custkey").alias("key"), F.lit("base").alias("value"), F.lit(-1).cast("long").alias("at")), top, "key")
    changes = t("events").where("event_id % 3 = 0").select(F.col("user_id").cast("long").alias("key"), F.concat(F.lit("v"), "event_id").alias("value"), F.col("event_id").alias("at"))
    stored.upsert(spark, top, ddl, "key", changes, ["at"])
    return stored.read(spark, top, ddl).select("key", "value")


@query("""SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'http://h.i/a/x' WHEN 1 THEN 'http://h.i/x' WHEN 2 THEN 'http://h.i/x' || page_id WHEN 3 THEN 'http://h.i/a/' WHEN 4 THEN 'http://h.i/' WHEN 5 THEN 'http://h.i/b/c?q=../d' WHEN 6 THEN 'http://h.i/a/b/y#./z' ELSE 'http://o.p/../z' END AS resolved FROM pages""")
def links_dotted(t, spark, sf):
    """Links with `.` and `..` steps, below /a/b/page."""
    k = F.col("page_id")
    hrefs = ("../x", "../../x", "../../../x{k}", "./..", "../../.", "/a/./../b/c?q=../d", "./y#./z", "//o.p/../z")
    href = F.coalesce(*[F.when(k % 8 == i, filled(h, k=k)) for i, h in enumerate(hrefs)])
    return t("pages").select("page_id", urls.resolve_url(F.concat(F.lit("http://h.i/a/b/"), k.cast("string"), F.lit("?p=1")), href).alias("resolved"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pay ' || repeat('9', least(116, 90 + p_size)) WHEN 1 THEN 'a' || repeat('é', least(59, 40 + p_size)) ELSE repeat('日', least(40, 20 + p_size)) END AS shown FROM part""")
def salary_cut(t, spark, sf):
    """Salaries of about the greatest length, cut between characters."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("int")
    text = F.when(k % 3 == 0, F.concat(F.lit("pay "), F.repeat(F.lit("9"), 90 + n))).when(k % 3 == 1, F.concat(F.lit("a"), F.repeat(F.lit("é"), 40 + n))).otherwise(F.repeat(F.lit("日"), 20 + n))
    return t("part").select("p_partkey", salary.truncate_salary(text).alias("shown"))


#: Where the page tells its salary, in the order in which places count; the amount is told by the place.
_PLACES = (
    '<meta name="Job-Salary" content=" Rp  {n}00 ">', '<meta property="x:compensation" content="none told">', '<b itemprop="baseSalary">Rp {n}01</b>', '<i itemprop="salary" content="USD {n}02"></i>', '<p class="x-salary-y">Gaji {n}03</p>',
    '<p class="TheSalary">Rp {n}04</p>', '<p id="salary1">Rp {n}05</p>', '<p id="xSalary">Rp {n}06</p>', '<p data-automation="jobsalary">Rp {n}07</p>', '<p class="a job-salary">Rp {n}08</p>', '<p id="job-salary">Rp {n}09</p>',
)


@query("""WITH x AS (SELECT p_partkey, p_partkey % 13 AS k, p_size AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Rp ' || n || '00' WHEN 1 THEN 'none told' WHEN 2 THEN 'Rp ' || n || '01' WHEN 3 THEN 'USD ' || n || '02' WHEN 4 THEN 'Gaji ' || n || '03' WHEN 11 THEN 'Rp ' || n || '77' WHEN 12 THEN 'pay ' || n || '88'
    ELSE 'Rp ' || n || '0' || (k - 1) END AS salary FROM x""")
def static_salaries(t, spark, sf):
    """Pages of unknown sites that tell a salary in a meta, by one of nine selectors, in the title or in the text; later places and what looks like no salary don't count."""
    k, v = F.col("p_partkey"), {"n": F.col("p_size")}
    own = F.coalesce(*[F.when(k % 13 == i, filled(p, **v)) for i, p in enumerate(_PLACES)], F.lit(""))
    other = F.when(k % 13 < 7, '<p id="job-salary">Rp 5</p>').otherwise('<p class="salary">to be told</p>')
    title = F.when(k % 13 == 11, filled("Cook Rp {n}77", **v)).otherwise("Cook")
    text = F.when(k % 13 == 12, filled("We look for a cook who likes to cook, pay {n}88", **v)).otherwise("We look for a cook who likes to cook and to eat well")
    body = F.concat(F.lit("<html><head>"), F.when(k % 13 < 2, own).otherwise(""), F.lit("</head><body><h1>"), title, F.lit("</h1>"), F.when(k % 13 >= 2, own).otherwise(""), other, F.lit("<article>"), text, F.lit("</article></body></html>"))
    url = F.concat(F.lit("https://h.example/about/"), k.cast("string"))
    ads = adapters.parse_pages(t("part").select("p_partkey", url.alias("requested_url"), url.alias("final_url"), body.alias("body")))
    return ads.select("p_partkey", "salary")


@query("""SELECT s_suppkey, 'https://own.example/' || s_suppkey AS source_url, CASE WHEN s_suppkey % 3 <> 0 THEN 'Own ' || s_name END AS title, s_suppkey % 3 = 0 AS failed FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'https://own.example/' || s_suppkey, s_name, false FROM supplier WHERE s_suppkey % 2 = 1""")
def own_adapter(t, spark, sf):
    """A user's adapter for some pages beside the built-in one for the others."""
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://own.example/"), k.cast("string"))
    body = filled("<title>x</title><h1>{name}</h1><h2>{sub}</h2>", name=F.col("s_name"), sub=F.when(k % 3 != 0, F.col("s_name")))
    pages = t("supplier").select("s_suppkey", url.alias("requested_url"), url.alias("final_url"), body.alias("body"), F.when(k % 2 == 0, "own").otherwise("static").alias("adapter"))

    def own(df):
        title = F.when(F.col("facts.h2") != "", F.concat(F.lit("Own "), "facts.h2")).otherwise("")
        empty = F.lit("")
        return df.withColumn("ads", F.array(F.struct(F.col("final_url").alias("source_url"), title.alias("title"), empty.alias("company"), empty.alias("salary"), empty.alias("description"))))

    adapters.register_adapter("own", own)
    try:
        ads = adapters.parse_pages(pages)
    finally:
        adapters.unregister_adapter("own")
    return ads.select("s_suppkey", F.coalesce("source_url", F.concat(F.lit("https://own.example/"), k.cast("string"))).alias("source_url"), "title", F.col("error").isNotNull().alias("failed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'Said title' WHEN o_orderkey % 2 = 0 THEN '' ELSE 'T' END AS title,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'C' END AS company, 's' AS salary FROM orders""")
def own_extractor(t, spark, sf):
    """A user's extractor asked for the empty fields of ads; it fails on some, which stay."""
    k = F.col("o_orderkey")
    ads = t("orders").select("o_orderkey", k.cast("string").alias("source_url"), F.when(k % 2 == 0, "").otherwise("T").alias("title"), F.when(k % 3 == 0, " ").otherwise("C").alias("company"), F.lit("s").alias("salary"),
                             F.concat(F.when(k % 5 == 0, "broken ").otherwise("post "), "o_orderstatus").alias("description"))

    def extract(text, missing):
        kind, status = text.split(" ")
        if kind == "broken":
            raise ValueError(text)
        return (" Said title " if "title" in missing else "X", status if "company" in missing else "X", "X")

    return adapters.fill_with(ads, extract).select("o_orderkey", "title", "company", "salary")
