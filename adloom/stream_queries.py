"""Streams that meet replays, repeats, stops and bad lines, over the given tables; and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adloom.plans import messages
from adloom.queries import _FOUND, _STRIP, _messages, query
from adloom.sources import tables
from adloom.sources.schemas import UPDATE
from adloom.streaming import target as store
from adloom.streaming import updates as chat


def _written(stream: DataFrame, top: str) -> StreamingQuery:
    """What a stream has so far, as Parquet below top."""
    return stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()


@query("SELECT conv_id * 100 + turn AS update_id, CAST(1 AS BIGINT) AS times, false AS again FROM conversations")
def replays_dropped(t, spark, sf):
    """Updates that come again in a later file, with another text, are not handed on again."""
    top, c = tables.new_folder(spark), t("conversations")
    half = c.agg(F.max("conv_id")).first()[0] / 2
    text = F.struct(F.lit(1).cast("long").alias("message_id"), F.col("text"), F.struct(F.lit(0).cast("long").alias("id")).alias("chat")).alias("message")
    updates = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("update_id"), text, "conv_id", "turn")
    old = updates.where(F.col("conv_id") < half)
    replay = old.where("turn % 2 = 0").withColumn("message", F.col("message").withField("text", F.lit("again")))
    for part in (old, updates.where(F.col("conv_id") >= half).unionByName(replay)):
        part.select("update_id", "message").write.mode("append").json(f"{top}/updates")
        _written(chat.guard_replays(tables.read_updates(spark, f"{top}/updates")), top).awaitTermination()
    told = spark.read.schema(UPDATE).parquet(f"{top}/out")
    return told.groupBy("update_id").agg(F.count("*").alias("times"), F.coalesce(F.bool_or(F.col("message.text") == "again"), F.lit(False)).alias("again"))


@query("SELECT DISTINCT url, CAST(1 AS BIGINT) AS times FROM pages")
def repeats_dropped(t, spark, sf):
    """Links that come again within a file or in a later one are handed on once; late ones are not lost."""
    top, pages = tables.new_folder(spark), t("pages").select("url")
    for part in (pages.where("page_id % 2 = 0"), pages.unionByName(pages.where("page_id % 3 = 0"))):
        part.write.mode("append").parquet(f"{top}/links")
        _written(chat.drop_repeats(spark.readStream.schema("url string").parquet(f"{top}/links")), top).awaitTermination()
    return spark.read.schema("url string").parquet(f"{top}/out").groupBy("url").agg(F.count("*").alias("times"))


@query("SELECT 'http://h.example/' || l_partkey AS source_url, CAST(1 AS BIGINT) AS times FROM lineitem GROUP BY l_partkey")
def target_batches(t, spark, sf):
    """A stream in more micro-batches than a target keeps folders: every address is stored once."""
    top = tables.new_folder(spark)
    rows = t("lineitem").select(F.concat(F.lit("http://h.example/"), "l_partkey").alias("source_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    rows.repartition(store.FAN + 2).write.parquet(f"{top}/in")
    stream = spark.readStream.schema("source_url string, pos long").option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    chat.stream_ingest(stream, f"{top}/ads", f"{top}/progress").awaitTermination()
    return store.read_rows(spark, f"{top}/ads", "source_url string, pos long").groupBy("source_url").agg(F.count("*").alias("times"))


@query(_FOUND + f""", p AS (SELECT l.update_id, l.pos, l.url, {_STRIP.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS title FROM l JOIN (SELECT url, min(html) AS html FROM pages WHERE page_id % 3 <> 0 GROUP BY url) USING (url)),
q AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY update_id, pos) = 1 AS inserted FROM p), s AS (SELECT l.update_id, l.url, q.url IS NOT NULL AS ok, coalesce(q.inserted, false) AS inserted, CASE WHEN q.inserted THEN CASE WHEN title = '' THEN q.url ELSE title END END AS title
    FROM l LEFT JOIN q ON q.update_id = l.update_id AND q.pos = l.pos)
SELECT 'link' AS kind, update_id, url, CASE WHEN inserted THEN 'inserted' WHEN ok THEN 'ok' ELSE 'failed' END AS said, title FROM s
UNION ALL SELECT 'outcome', w.update_id, NULL, CASE WHEN bool_or(ok) THEN 'success' WHEN bool_or(NOT ok) THEN 'failure' ELSE 'none' END, NULL FROM w LEFT JOIN s USING (update_id) GROUP BY w.update_id
UNION ALL SELECT 'mark', max(update_id), NULL, count(*) FILTER (WHERE chat <> 1) || ' messages ' || (SELECT count(*) FROM s) || ' links ' || (SELECT count(*) FROM s WHERE inserted) || ' scraped ' || (SELECT count(*) FROM s WHERE NOT ok) || ' errors', NULL FROM m""")
def message_units(t, spark, sf):
    """Messages in three files, the last with replays; the second run is stopped before its commit and started again."""
    top, updates = tables.new_folder(spark), tables.staged(_messages(t))
    fetched = tables.staged(t("pages").where("page_id % 3 <> 0").groupBy("url").agg(F.min("html").alias("body")))
    last = updates.agg(F.max("update_id")).first()[0] or 0
    stops = {1}

    def fetch(links: DataFrame) -> DataFrame:
        return fetched.join(links, "url", "left_semi").select(F.col("url").alias("requested_url"), F.col("url").alias("final_url"), "body")

    def stream() -> None:
        got = spark.readStream.schema(UPDATE).parquet(f"{top}/updates")

        def unit(batch: DataFrame, number: int) -> None:
            if number in stops:  # all is written but the commit
                stops.remove(number)
                messages.message_unit(batch, number, 0, fetch, f"{top}/chat")
                store.remove(spark, f"{top}/chat/commits/batch={number}")
                raise InterruptedError("stopped")
            messages.message_unit(batch, number, 0, fetch, f"{top}/chat")

        got.writeStream.foreachBatch(unit).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()

    cut = [0, last // 3, 2 * last // 3, last]
    for k in range(3):
        new = updates.where((F.col("update_id") > cut[k]) & (F.col("update_id") <= cut[k + 1])) if k else updates.where(F.col("update_id") <= cut[1])
        (new.unionByName(updates.where(F.col("update_id") <= cut[1])) if k == 2 else new).write.mode("append").parquet(f"{top}/updates")
        try:
            stream()
        except Exception:  # as a job that is started again
            if k != 1:
                raise
            stream()
    read = lambda name, ddl: store.read_table(spark, f"{top}/chat", name, ddl)
    titles = store.read_rows(spark, f"{top}/chat", messages.ADS).select("update_id", F.col("pos"), "title")
    links = read("links", messages.LINKS).join(titles, ["update_id", "pos"], "left").select("update_id", "url", "title")
    said = F.when(F.col("inserted"), "inserted").when(F.col("ok"), "ok").otherwise("failed")
    rows = read("results", messages.RESULTS).join(links, ["update_id", "url"]).select(F.lit("link").alias("kind"), "update_id", "url", said.alias("said"), "title")
    none = F.lit(None).cast("string")
    outcomes = read("outcomes", messages.OUTCOMES).select(F.lit("outcome").alias("kind"), "update_id", none.alias("url"), F.col("outcome").alias("said"), none.alias("title"))
    sums = read("commits", messages.COMMITS).agg(F.max("last_update_id").alias("update_id"), *[F.sum(c).cast("string").alias(c) for c in ("messages_checked", "links_found", "links_scraped", "errors")])
    told = F.concat("messages_checked", F.lit(" messages "), "links_found", F.lit(" links "), "links_scraped", F.lit(" scraped "), "errors", F.lit(" errors"))
    return rows.unionByName(outcomes).unionByName(sums.select(F.lit("mark").alias("kind"), "update_id", none.alias("url"), told.alias("said"), none.alias("title")))


@query("""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'no json' WHEN 2 THEN 'no update id' WHEN 3 THEN 'no update id' ELSE 'good' END AS said FROM pages WHERE page_id % 5 <> 4""")
def updates_flagged(t, spark, sf):
    """Lines of update files: good ones, and those that are no JSON or lack an id, flagged with their text."""
    top, k = tables.new_folder(spark), F.col("page_id")
    body = F.concat(F.lit(', "message": {"message_id": '), k.cast("string"), F.lit(', "text": "t", "chat": {"id": 1}}}'))
    line = (F.when(k % 5 == 0, F.concat(F.lit('{"update_id": '), k.cast("string"), body)).when(k % 5 == 1, F.concat(F.lit('{"update_id": '), k.cast("string"), F.lit(", ")))
            .when(k % 5 == 2, F.concat(F.lit('{"other": 1'), body)).when(k % 5 == 3, F.concat(F.lit('{"update_id": "x'), k.cast("string"), F.lit('"'), body)).otherwise("  "))
    t("pages").select(line.alias("value")).write.text(f"{top}/updates")
    _written(tables.read_updates(spark, f"{top}/updates"), f"{top}/good").awaitTermination()
    _written(tables.dead_letters(spark, f"{top}/updates"), f"{top}/bad").awaitTermination()
    good = spark.read.schema(UPDATE).parquet(f"{top}/good/out").select(F.col("message.message_id").alias("page_id"), F.lit("good").alias("said"))
    bad = spark.read.schema("line string, reason string").parquet(f"{top}/bad/out")
    number = F.coalesce(F.regexp_extract("line", r'message_id": (\d+)', 1).try_cast("long"), F.regexp_extract("line", r'update_id": (\d+)', 1).try_cast("long"))
    return good.unionByName(bad.select(number.alias("page_id"), F.col("reason").alias("said")))
