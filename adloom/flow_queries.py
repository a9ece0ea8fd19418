"""Readers and writers, the crawl, messages and streams over the given tables; scalars that no other query names; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.board_queries import filled
from adloom.functions import captions, prompts, salary, text, urls
from adloom.operators import adapters, ingest
from adloom.plans.crawl import crawl, ingest_messages
from adloom.queries import _FOUND, _STRIP, _messages, query
from adloom.sources import tables
from adloom.streaming import updates as chat


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || '#f' END AS final_url, md5(html) AS body_md5 FROM pages WHERE page_id % 4 <> 1")
def pages_read(t, spark, sf):
    """Fetched pages, written and read back: only good ones, with a final address."""
    k, top = F.col("page_id"), tables.new_folder(spark)
    t("pages").select("page_id", k.alias("source_id"), F.lit(1).alias("page_no"), F.col("url").alias("requested_url"), F.when(k % 3 != 0, F.concat("url", F.lit("#f"))).alias("final_url"),
                      F.when(k % 4 == 1, 404).otherwise(200 + k % 7).cast("int").alias("http_status"), F.col("html").alias("body")).write.parquet(top)
    return tables.read_pages(spark, top).select("page_id", "final_url", F.md5("body").alias("body_md5"))


@query("SELECT n_nationkey, n_nationkey % 4 <> 3 AS ok, CASE WHEN n_nationkey % 4 <> 3 THEN n_name END AS name FROM nation")
def api_files(t, spark, sf):
    """A file a search result; a body that is no JSON is a flagged row."""
    top = tables.new_folder(spark)
    body = F.when(F.col("n_nationkey") % 4 == 3, F.concat(F.lit("<html>\n"), "n_name")).otherwise(F.concat(F.lit("{\n"), F.lit('"name": "'), "n_name", F.lit('"}')))
    t("nation").select("n_nationkey", body.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(top)
    pages = tables.read_api_pages(spark, top + "/*")
    return pages.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "ok", F.try_variant_get("payload", "$.name", "string").alias("name"))


@query("""SELECT event_id AS id, user_id AS source_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'new' END AS status, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE date_trunc('second', ts) END AS scraped_at FROM events""")
def ads_stored(t, spark, sf):
    """Ads appended to a table in two runs and read back: blank statuses and missing scrape times are filled."""
    top, empty = tables.new_folder(spark), F.lit("")
    k, at = F.col("event_id"), F.date_trunc("second", "ts")
    ads = t("events").select(k.alias("id"), F.col("user_id").alias("source_id"), F.concat(F.lit("u"), k.cast("string")).alias("source_url"), empty.alias("title"), empty.alias("company"), empty.alias("salary"), empty.alias("description"),
                             at.alias("posted_at"), F.when(k % 5 != 0, at).alias("scraped_at"), F.when(k % 3 == 0, F.col("event_type")).when(k % 3 == 1, " ").alias("status"))
    for part in (ads.where("id % 2 = 0"), ads.where("id % 2 = 1")):
        tables.write_ads(part, top, F.lit("2024-02-01").cast("timestamp"))
    return tables.read_ads(spark, top).select("id", "source_id", "status", "scraped_at")


@query("SELECT s_suppkey AS id, s_name AS name, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS place FROM supplier WHERE s_acctbal > 0")
def sources_listed(t, spark, sf):
    """Enabled sources by id; places follow the order of the list."""
    ordered = tables.list_sources(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("enabled")), True)
    return _placed(ordered.select("id", "name"))


@query("SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS value, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS place FROM nation")
def profile_listed(t, spark, sf):
    return _placed(tables.list_profile(t("nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))))


def _placed(ordered: DataFrame) -> DataFrame:
    """Rows of an ordered frame with their places, from the order of its partitions."""
    at = tables.staged(ordered.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    return ingest.assign_ids(at, -1, ["at"]).select("row.*", F.col("id").cast("int").alias("place"))


@query("""WITH n AS (SELECT 'u' || l_partkey AS source_url, l_orderkey * 10 + l_linenumber AS pos, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k, l_partkey % 3 = 0 AS stored FROM lineitem)
SELECT source_url, pos FROM n WHERE stored OR k > 1""")
def skipped_ads(t, spark, sf):
    """Rows that insert-if-new passes over: their address is stored, or stood before."""
    incoming = t("lineitem").select(F.concat(F.lit("u"), "l_partkey").alias("source_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    stored = t("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("u"), "p_partkey").alias("source_url"))
    return ingest.insert_if_new(stored, incoming, ("pos",))[1]


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def times_parsed(t, spark, sf):
    k = F.col("event_id") % 8
    raw = F.when(k == 0, "yesterday").when(k == 4, F.date_format("ts", "yyyy-MM-dd")).otherwise(text.format_ts(F.col("ts")))
    at = t("events").select("event_id", text.parse_ts(raw).alias("at"))
    return at.select("event_id", "at", text.format_ts(F.col("at")).alias("shown"))


@query("""SELECT p_partkey, p_size % 4 <> 3 AS paid, CASE p_partkey % 5 WHEN 0 THEN 'Salary Undisclosed' WHEN 1 THEN 'Salary Undisclosed' WHEN 2 THEN 'Negotiable' WHEN 3 THEN 'Gaji Tidak Diumumkan' ELSE '' END AS shown,
CASE WHEN p_size % 4 = 3 THEN '' ELSE 'Rp ' || p_size END AS shortest FROM part""")
def salary_words(t, spark, sf):
    """What counts as a salary on one board, the shortest of several, and what stands where there is none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    said = F.when(size % 4 == 0, filled("Gaji Rp {s} ya", s=size)).when(size % 4 == 1, "UNDISCLOSED").when(size % 4 == 2, filled("US$ {s}", s=size)).otherwise(filled("rp {s} or much", s=size))
    board = F.element_at(F.array(*map(F.lit, ("jobstreet", "glints", "dealls", "kalibrr", "static"))), (k % 5 + 1).cast("int"))
    texts = F.when(size % 4 == 3, F.array(said)).otherwise(F.array(filled("Salary: Rp {s}", s=size), filled("Rp {s}", s=size), filled("Rp {s}", s=size), F.lit("12")))
    return t("part").select("p_partkey", salary.looks_like_glints_salary(said).alias("paid"), salary.default_salary(board, F.lit("")).alias("shown"), adapters.glints_salary(texts, F.array(F.lit(""))).alias("shortest"))


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_replace(url, '[?#].*$', '') AS clean FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'mailto:a@b.c' WHEN 2 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//h.i/p' WHEN 3 THEN root || '/a/b?c' WHEN 4 THEN clean || '?q=1'
ELSE CASE WHEN regexp_matches(clean, '://[^/]*/') THEN regexp_replace(clean, '[^/]*$', '') ELSE clean || '/' END || 'x/y' END AS resolved,
CASE WHEN page_id % 3 = 0 THEN 'https://www.threads.com/@a.b/post/C' || page_id WHEN page_id % 3 = 1 THEN 'https://www.threads.com/@page/post/P' || page_id ELSE clean END AS post FROM u""")
def links_resolved(t, spark, sf):
    """Links of a page as absolute addresses, and the canonical address of a post."""
    k, url = F.col("page_id"), F.col("url")
    href = F.element_at(F.array(*map(F.lit, ("", "mailto:a@b.c", "//h.i/p", "/a/b?c", "?q=1", "x/y"))), (k % 6 + 1).cast("int"))
    own = F.when(k % 3 == 1, F.concat(F.lit("https://www.threads.net/@page/post/P"), k.cast("string"), F.lit("/?x=1#y"))).otherwise(url)
    og = F.when(k % 3 == 0, F.concat(F.lit(" http://Threads.net/@a.b/post/C"), k.cast("string"), F.lit(" "))).when(k % 3 == 1, "https://threadless.com/@a/post/B")
    return t("pages").select("page_id", urls.resolve_url(url, href).alias("resolved"), urls.canonical_threads_url(own, og).alias("post"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Hello there ' || doc_id || ' and more' WHEN doc_id % 3 = 1 THEN 'Hello there ' || doc_id ELSE 'Hello   there ' || doc_id || ' a' END AS best FROM documents""")
def captions_best(t, spark, sf):
    """The longest text that goes on from the seed, or that the seed goes on from; others never."""
    k = F.col("doc_id")
    seed = filled(" Hello there {k}", k=k)
    texts = (F.when(k % 3 == 0, F.array(filled("Hello there {k} and", k=k), filled("Hello  there\n{k}", k=k), filled("Hello there {k} and more", k=k), F.lit("another text that is much longer than the seed")))
             .when(k % 3 == 1, F.array(F.lit("Hello"), F.lit("Other " * 9))).otherwise(F.array(filled("Hello   there {k} a", k=k), filled("Hello there {k} a", k=k))))
    return t("documents").select("doc_id", captions.best_caption(seed, texts).alias("best"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Letter ' || o_orderkey || chr(10) || chr(10) || 'Yours' ELSE 'Letter ' || o_orderkey END AS letter,
CASE WHEN o_orderkey % 3 = 0 THEN 'Be brief ' || o_orderkey ELSE (SELECT 'You write tailored cover letters for job applications. Use only the candidate profile and job description given; never invent employers, degrees, skills, or experience. Output the letter body only, no markdown fences.') END
    || chr(10) || chr(10) || 'Candidate profile:' || chr(10) || '- skills: ' || o_orderstatus || chr(10) || chr(10) || 'Job Ad:' || chr(10) || chr(10) || chr(10) || 'Write a tailored cover letter.' AS paste,
'Extract only these fields from the post: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'title, salary' ELSE 'title, company, salary' END || '.' || chr(10) || 'Return JSON with those keys. Use empty strings when unknown.' || chr(10) || chr(10) || 'Post:' || chr(10) || o_orderpriority AS extract FROM orders""")
def letter_texts(t, spark, sf):
    """A letter with its signature, the prompt to paste, and the extractor's prompt."""
    k, none = F.col("o_orderkey"), F.lit(" ")
    profile = F.create_map(F.lit("skills"), F.concat(F.lit(" "), "o_orderstatus"), F.lit("signature"), F.lit("Yours"), F.lit("summary"), F.lit(""))
    letter = prompts.with_signature(filled("Letter {k}", k=k), F.when(k % 2 == 0, " Yours "))
    missing = prompts.missing_fields(none, F.when(k % 2 == 0, "C"), F.lit(None).cast("string"))
    return t("orders").select("o_orderkey", letter.alias("letter"), prompts.paste_prompt(profile, F.when(k % 3 == 0, filled("Be brief {k}", k=k)).otherwise("")).alias("paste"), prompts.extract_prompt(missing, F.col("o_orderpriority")).alias("extract"))


@query(f"""WITH c AS (SELECT conv_id, turn, 'http://h.example/' || conv_id || '/' || (turn % 3) || ' and https://www.glints.com/x' AS text FROM conversations WHERE conv_id % 4 <> 1)
SELECT conv_id * 100 + turn AS update_id, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN 'http://h.example/' || conv_id || '/' || (turn % 3) ELSE 'https://www.glints.com/x' END AS url, CASE p WHEN 0 THEN 'static' ELSE 'glints' END AS adapter FROM c, range(2) r(p)""")
def stream_links(t, spark, sf):
    """Updates as JSON files, read as a stream: each is handed on once."""
    top = tables.new_folder(spark)
    body = F.concat(F.lit("http://h.example/"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") % 3).cast("string"), F.lit(" and https://www.glints.com/x"))
    chat_id = F.when(F.col("conv_id") % 4 == 1, 1).otherwise(0).cast("long")
    t("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("update_id"), F.struct(F.col("turn").alias("message_id"), body.alias("text"), F.struct(chat_id.alias("id")).alias("chat")).alias("message")).write.json(f"{top}/updates")
    links = chat.stream_links(tables.read_updates(spark, f"{top}/updates"), 0)
    links.writeStream.format("parquet").option("path", f"{top}/links").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/links")


@query(_FOUND + """, o AS (SELECT update_id, CASE WHEN bool_or(ok) THEN 'success' WHEN bool_or(NOT ok) THEN 'failure' ELSE 'none' END AS outcome FROM w LEFT JOIN r USING (update_id) GROUP BY update_id)
SELECT outcome AS kind, CASE outcome WHEN 'success' THEN 'Processed ✅' WHEN 'failure' THEN 'Couldn''t process ⚠️' END AS reply, count(*) AS n FROM o GROUP BY ALL
UNION ALL SELECT 'messages', NULL, count(*) FROM w UNION ALL SELECT 'links', NULL, count(*) FROM r UNION ALL SELECT 'scraped', NULL, count(*) FROM r WHERE ok AND inserted UNION ALL SELECT 'errors', NULL, count(*) FROM r WHERE NOT ok
UNION ALL SELECT 'last', NULL, max(update_id) FROM w""")
def stream_check(t, spark, sf):
    """A chat's check, micro-batch by micro-batch: outcomes with replies, and sums of the batches' summaries."""
    top = tables.new_folder(spark)
    _messages(t).write.parquet(f"{top}/updates")
    updates = spark.readStream.schema("update_id long, message struct<message_id: long, text: string, chat: struct<id: long>>").option("maxFilesPerTrigger", 1).parquet(f"{top}/updates")
    handle = lambda wanted, number: chat.message_links(wanted).select("update_id", "url", (F.length("url") % 3 != 0).alias("ok"), (F.length("url") % 2 == 0).alias("inserted"))
    chat.stream_check(updates, 0, handle, f"{top}/out", f"{top}/progress").awaitTermination()
    outcomes = spark.read.parquet(f"{top}/out/outcomes").groupBy(F.col("outcome").alias("kind"), "reply").agg(F.count("*").alias("n"))
    names = {"messages_checked": "messages", "links_found": "links", "links_scraped": "scraped", "errors": "errors", "last_update_id": "last"}
    sums = spark.read.parquet(f"{top}/out/summary").agg(*[(F.max if c == "last_update_id" else F.sum)(c).cast("long").alias(n) for c, n in names.items()])
    return outcomes.unionByName(sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names.values())), F.array(*names.values()))).alias("kind", "n")).withColumn("reply", F.lit(None).cast("string")))


_JOB = "'https://id.jobstreet.com/id/job/' || (s_suppkey * 10 + {})"
_CRAWL = f"""WITH s AS (SELECT *, s_suppkey % 7 AS kind FROM supplier), a AS (
    SELECT s_suppkey AS source_id, 'http://h.example/jobs/' || s_suppkey AS source_url, s_name AS title, '' AS company FROM s WHERE kind = 0
    UNION ALL SELECT s_suppkey, {_JOB.format("i")}, CASE WHEN i = 1 THEN 'Full ' || s_suppkey ELSE 'Job ' || i END, CASE WHEN i = 1 THEN 'Nation ' || s_nationkey ELSE '' END FROM s, range(1, 4) r(i) WHERE kind = 1
    UNION ALL SELECT s_suppkey, 'https://glints.com/opportunities/jobs/a/11111111-2222-3333-4444-' || lpad(CAST(s_nationkey AS VARCHAR), 12, '0'), s_name, 'G' FROM s WHERE kind = 2
    UNION ALL SELECT s_suppkey, 'https://dealls.com/loker/' || CASE i WHEN 0 THEN 'a' ELSE 'b' END || s_suppkey || '~co', CASE i WHEN 0 THEN 'plain' ELSE s_name END, CASE i WHEN 0 THEN '' ELSE 'Co' END FROM s, range(2) r(i) WHERE kind = 3
    UNION ALL SELECT s_suppkey, 'https://www.kalibrr.id/id-ID/c/c/jobs/' || (s_suppkey + 1) || '/s', s_name, 'K' FROM s WHERE kind = 4
), f AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY source_id) AS k, source_id % 4 = 0 AND NOT source_url LIKE '%glints%' AS stored FROM a),
o AS (SELECT source_id, CASE WHEN k = 1 AND NOT stored THEN 'new' ELSE 'skipped' END AS outcome, source_url, title, company FROM f)
"""


@query(_CRAWL + """SELECT * FROM o UNION ALL SELECT s_suppkey, 'error', NULL, NULL, NULL FROM s WHERE kind = 6
UNION ALL SELECT NULL, 'sources ' || (SELECT count(*) FROM s) || ' new ' || (SELECT count(*) FROM o WHERE outcome = 'new') || ' skipped ' || (SELECT count(*) FROM o WHERE outcome = 'skipped') || ' errors ' || (SELECT count(*) FROM s WHERE kind = 6), NULL, NULL, NULL""")
def crawl_run(t, spark, sf):
    """A whole crawl: five kinds of sources, walks over pages and search results, details, stored ads; new and skipped ads, failed sources, the run's summary."""
    s, kind, k = t("supplier"), F.col("s_suppkey") % 7, F.col("s_suppkey")
    v = {"k": k, "name": F.col("s_name"), "nation": F.col("s_nationkey")}
    adapter = F.element_at(F.array(*map(F.lit, ("static", "jobstreet", "glints", "dealls", "kalibrr", "telegram", "who"))), (kind + 1).cast("int"))
    sources = s.select(k.alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("url"), adapter.alias("adapter"), F.lit(True).alias("enabled"))
    card = lambda n: f'<div data-automation="normalJob"><a data-automation="job-list-view-job-link" href="/id/job/{{k}}{n}">Job {n}</a></div>'

    def page(of: int, number: int, url: str, body: str) -> DataFrame:
        u = filled(url, **v)
        return s.where(kind == of).select(k.alias("source_id"), F.lit(number).alias("page_no"), u.alias("requested_url"), u.alias("final_url"), filled(body, **v).alias("body"))

    pages = page(0, 1, "http://h.example/jobs/{k}", "<h1>{name}</h1>")
    for more in (
        page(1, 1, "https://id.jobstreet.com/jobs-{k}", card(1) + card(2) + '<a rel="next" href="?page=2">n</a>'), page(1, 2, "https://id.jobstreet.com/jobs-{k}?page=2", card(2) + card(3)),
        page(1, 3, "https://id.jobstreet.com/jobs-{k}?page=3", card(9)),
        _glints(s, kind, k),
        page(3, 1, "https://dealls.com/?searchJob={k}", '<div id="jobs-container"><a href="/loker/a{k}~co">plain</a></div>'),
    ):
        pages = pages.unionByName(more)
    job = F.struct(F.col("s_name").alias("role"), F.concat(F.lit("b"), k.cast("string")).alias("slug"), F.struct(F.lit("Co").alias("name"), F.lit("co").alias("slug")).alias("company"))
    dealls = F.to_json(F.struct(F.lit(200).alias("code"), F.struct(F.array(job).alias("docs"), F.lit(2).alias("totalPages")).alias("data")))
    kalibrr = F.to_json(F.struct(F.lit(1).alias("count"), F.array(F.struct((k + 1).alias("id"), F.col("s_name").alias("name"), F.lit("s").alias("slug"), F.struct(F.lit("c").alias("code"), F.lit("K").alias("name")).alias("company"))).alias("jobs")))
    api = s.where(kind.isin(3, 4)).select(k.alias("source_id"), F.when(kind == 3, 2).otherwise(0).alias("page_no"), F.when(kind == 3, dealls).otherwise(kalibrr).alias("body"))
    own = filled("https://id.jobstreet.com/id/job/{k}1", **v)
    details = s.where(kind == 1).select(own.alias("requested_url"), own.alias("final_url"), filled('<h1 data-automation="job-detail-title">Full {k}</h1><b data-automation="advertiser-name">Nation {nation}</b>', **v).alias("body"))
    fourth = s.where("s_suppkey % 4 = 0")
    stored = fourth.select(F.explode(F.array(filled("http://h.example/jobs/{k}", **v), *[filled(f"https://id.jobstreet.com/id/job/{{k}}{n}", **v) for n in (1, 2, 3)], filled("https://dealls.com/loker/a{k}~co", **v), filled("https://dealls.com/loker/b{k}~co", **v),
                                             filled("https://www.kalibrr.id/id-ID/c/c/jobs/{next}/s", next=k + 1))).alias("source_url"))
    out = crawl(sources, pages, api, details, stored)
    names, none = ("source_id", "outcome", "source_url", "title", "company"), F.lit(None).cast("string")
    rows = [out[o].withColumn("outcome", F.lit(o)).select(*names) for o in ("new", "skipped")]
    rows.append(out["errors"].select("source_id", F.lit("error").alias("outcome"), none.alias("source_url"), none.alias("title"), none.alias("company")))
    told = filled("sources {a} new {b} skipped {c} errors {d}", a=F.col("sources"), b=F.col("new_ads"), c=F.col("skipped"), d=F.col("errors"))
    rows.append(out["summary"].where("level = 'run'").select(F.lit(None).cast("long").alias("source_id"), told.alias("outcome"), none.alias("source_url"), none.alias("title"), none.alias("company")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _glints(s: DataFrame, kind, k) -> DataFrame:
    url = F.lit("https://glints.com/id/opportunities/explore")
    body = filled('<div data-gtm-job-id="1" data-gtm-company-name="G"><a href="/opportunities/jobs/a/11111111-2222-3333-4444-{id}"><h2 class="JobTitle">{name}</h2></a></div>',
                  id=F.lpad(F.col("s_nationkey").cast("string"), 12, "0"), name=F.col("s_name"))
    return s.where(kind == 2).select(k.alias("source_id"), F.lit(1).alias("page_no"), url.alias("requested_url"), url.alias("final_url"), body.alias("body"))


@query(_FOUND + f""", p AS (SELECT l.update_id, l.pos, l.url, {_STRIP.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS title FROM l JOIN (SELECT url, min(html) AS html FROM pages WHERE page_id % 3 <> 0 GROUP BY url) USING (url)),
q AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY update_id, pos) AS k, url IN (SELECT url FROM pages WHERE page_id % 10 = 1) AS stored FROM p)
SELECT l.update_id, l.url, q.url IS NOT NULL AS ok, coalesce(k = 1 AND NOT stored, false) AS inserted, CASE WHEN k = 1 AND NOT stored THEN CASE WHEN title = '' THEN q.url ELSE title END END AS title FROM l LEFT JOIN q ON q.update_id = l.update_id AND q.pos = l.pos""")
def messages_run(t, spark, sf):
    """Links of messages whose pages were fetched become ads, if they are not stored yet."""
    fetched = t("pages").where("page_id % 3 <> 0").groupBy("url").agg(F.min("html").alias("body")).select(F.col("url").alias("requested_url"), F.col("url").alias("final_url"), "body")
    stored = t("pages").where("page_id % 10 = 1").select(F.col("url").alias("source_url"))
    out = ingest_messages(_messages(t), 0, fetched, stored)
    titles = out["new"].select("update_id", "url", "title")
    return out["results"].join(titles, ["update_id", "url"], "left").select("update_id", "url", "ok", "inserted", "title")
