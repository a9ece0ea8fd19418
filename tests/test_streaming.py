import json


from adloom.sources import tables
from adloom.streaming import target as T
from adloom.streaming import updates as U

UPDATES = [
    {"update_id": 1, "message": {"message_id": 1, "text": "see https://glints.com/a, and https://x.y/1 https://x.y/1", "chat": {"id": 7}}},
    {"update_id": 2, "message": {"message_id": 2, "text": "https://other.z/", "chat": {"id": 8}}},
    {"update_id": 3},
    {"update_id": 4, "message": {"message_id": 3, "text": "no links", "chat": {"id": 7}}},
    {"update_id": 5, "message": {"message_id": 4, "text": "https://x.y/2", "chat": {"id": 7}}},
]
LINKS = [(1, "https://glints.com/a", "glints"), (1, "https://x.y/1", "static"), (5, "https://x.y/2", "static")]


def _write(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{rows[0]['update_id']}.json").write_text("\n".join(map(json.dumps, rows)))


def test_stream_is_the_batch(spark, tmp_path):
    _write(tmp_path / "in", UPDATES[:3])
    seen = []
    keep = lambda df, n: seen.extend((r.update_id, r.url, r.adapter) for r in df.collect())

    def run():
        q = U.stream_links(tables.read_updates(spark, str(tmp_path / "in")), 7).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sorted(seen) == LINKS[:2]
    _write(tmp_path / "in", UPDATES[3:])
    run()
    run()
    assert sorted(seen) == LINKS
    batch = spark.read.schema("update_id long, message struct<message_id: long, text: string, chat: struct<id: long>>").json(str(tmp_path / "in"))
    assert sorted((r.update_id, r.url, r.adapter) for r in U.stream_links(batch, 7).collect()) == LINKS
    assert tables.updates_after(batch, 3).count() == 2
    assert U.high_water_mark(batch, 3).first()[0] == 5 and U.high_water_mark(batch, 9).first()[0] == 9 and U.high_water_mark(batch.limit(0), 2).first()[0] == 2
    results = spark.createDataFrame([(1, "a", False, False), (1, "b", True, True), (5, "c", False, False)], "update_id long, url string, ok boolean, inserted boolean")
    messages = U.wanted_messages(batch, 7)
    assert {r.update_id: r.outcome for r in U.message_outcome(messages, results).collect()} == {1: "success", 4: "none", 5: "failure"}
    assert tuple(U.check_summary(messages, results).first()) == (3, 3, 1, 2)


def test_stream_ingest(spark, tmp_path):
    target, source = str(tmp_path / "ads"), tmp_path / "src"
    rows = lambda *r: spark.createDataFrame(r, "source_url string, title string, pos int").coalesce(1).write.mode("append").json(str(source))
    rows(("a", "A", 2), ("a", "first", 1), ("b", "B", 3))
    go = lambda: U.stream_ingest(spark.readStream.schema("source_url string, title string, pos int").json(str(source)), target, str(tmp_path / "ck")).awaitTermination()
    go()
    rows(("a", "again", 0), ("c", "C", 0))
    go()
    go()
    got = T.read_rows(spark, target, "source_url string, title string, pos int").select("source_url", "title").collect()
    assert sorted(map(tuple, got)) == [("a", "first"), ("b", "B"), ("c", "C")]


def test_crawl_and_messages(spark):
    from adloom.plans.crawl import crawl, ingest_messages

    sources = spark.createDataFrame([(1, "S", "https://id.jobstreet.com/jobs", "jobstreet", True), (2, "K", "https://www.kalibrr.id/home/te/x", "kalibrr", True), (3, "D", "https://dealls.com/", "dealls", True), (4, "W", "x", "who", True), (5, "T", "x", "telegram", True)],
                                    "id long, name string, url string, adapter string, enabled boolean")
    card = lambda n: f'<div data-automation=normalJob><a data-automation=job-list-view-job-link href="/job/{n}">J{n}</a></div>'
    pages = spark.createDataFrame([
        (1, 1, "https://id.jobstreet.com/jobs", "https://id.jobstreet.com/jobs", card(1) + card(2) + '<a rel=next href="?page=2">n</a>'),
        (1, 2, "https://id.jobstreet.com/jobs?page=2", "https://id.jobstreet.com/jobs?page=2", card(2) + card(3)),
        (3, 1, "https://dealls.com/", "https://dealls.com/", "<p>empty"),
    ], "source_id long, page_no int, requested_url string, final_url string, body string")
    job = {"id": 5, "name": "N", "slug": "n", "company": {"code": "c"}, "description": "<p>text</p>"}
    api = spark.createDataFrame([(2, 0, json.dumps({"count": 1, "jobs": [job]}))], "source_id long, page_no int, body string")
    details = spark.createDataFrame([("https://id.jobstreet.com/job/1", "https://id.jobstreet.com/job/1?x", "<h1 data-automation=job-detail-title>Full</h1>")], "requested_url string, final_url string, body string")
    stored = spark.createDataFrame([("https://id.jobstreet.com/job/3",)], "source_url string")
    out = crawl(sources, pages, api, details, stored)
    got = {r.source_url: (r.title, r.description) for r in out["new"].collect()}
    assert got == {"https://id.jobstreet.com/job/1": ("Full", ""), "https://id.jobstreet.com/job/2": ("J2", ""), "https://www.kalibrr.id/id-ID/c/c/jobs/5/n": ("N", "Deskripsi Pekerjaan\ntext")}
    run = out["summary"].where("level = 'run'").first()
    assert (run.sources, run.new_ads, run.skipped, run.errors) == (5, 3, 1, 2)
    ups = spark.createDataFrame([(1, (1, "https://x.y/job https://x.y/none", (7,)))], "update_id long, message struct<message_id: long, text: string, chat: struct<id: long>>")
    fetched = spark.createDataFrame([("https://x.y/job", "https://x.y/job", "<h1>Cook</h1>")], "requested_url string, final_url string, body string")
    m = ingest_messages(ups, 7, fetched, stored)
    assert [(r.source_url, r.title) for r in m["new"].collect()] == [("https://x.y/job", "Cook")]
    assert sorted((r.url, r.ok, r.inserted) for r in m["results"].collect()) == [("https://x.y/job", True, True), ("https://x.y/none", False, False)]


def test_links_of_one_id(spark):
    """Links of several messages under one id: none takes another's place, each stands once."""
    from adloom.plans.crawl import ingest_messages

    ups = spark.createDataFrame([(1, (1, "https://x.y/none https://x.y/job", (7,))), (1, (2, "https://x.y/job https://x.y/gone", (7,)))], tables.UPDATE)
    fetched = spark.createDataFrame([("https://x.y/job", "https://x.y/job", "<h1>Cook</h1>")], "requested_url string, final_url string, body string")
    m = ingest_messages(ups, 7, fetched, spark.createDataFrame([], "source_url string"))
    assert sorted((r.url, r.ok, r.inserted) for r in m["results"].collect()) == [("https://x.y/gone", False, False), ("https://x.y/job", True, True), ("https://x.y/none", False, False)]
    assert sorted((r.pos, r.url, r.adapter) for r in m["links"].collect()) == [(0, "https://x.y/job", "static"), (1, "https://x.y/none", "static"), (2, "https://x.y/gone", "static")]
    assert [(r.pos, r.title) for r in m["new"].collect()] == [(0, "Cook")]


def test_replays_across_runs(spark, tmp_path):
    """An id that was handed on is not handed on again, whatever lane it is in; ids of one batch may come in any order."""
    def run(lanes):
        guarded = U.guard_replays(tables.read_updates(spark, str(tmp_path / "in")), lanes)
        guarded.writeStream.format("json").option("path", str(tmp_path / f"out{lanes}")).option("checkpointLocation", str(tmp_path / f"ck{lanes}")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.update_id for r in spark.read.schema("update_id long").json(str(tmp_path / f"out{lanes}")).collect())

    _write(tmp_path / "in", [UPDATES[4], UPDATES[0], UPDATES[0], UPDATES[2]])
    assert run(4) == [1, 3, 5] and run(1) == [1, 3, 5]
    (tmp_path / "in" / "again.json").write_text("\n".join(map(json.dumps, [UPDATES[0], UPDATES[4], {"update_id": 9}, {"update_id": 2}])))
    assert run(1) == [1, 3, 5, 9]  # 2 lies below the mark
    assert set(run(4)) >= {1, 3, 5, 9}
    assert run(4).count(1) == run(4).count(5) == 1


def test_repeats_and_their_state(spark, tmp_path):
    """A link is handed on once within the time; state holds the links of that time only."""
    schema, seen = "url string, at timestamp", []

    def run(rows, name):
        spark.createDataFrame(rows, "url string, at string").selectExpr("url", "cast(at as timestamp) at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = U.drop_repeats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", time="at")
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.url for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    run([(f"u{k}", "2024-01-01 00:00:00") for k in range(50)] + [("u1", "2024-01-01 00:10:00")], "a")
    assert sorted(seen) == sorted(f"u{k}" for k in range(50))
    run([("u1", "2024-01-01 00:30:00"), ("new", "2024-01-01 00:20:00")], "b")
    assert seen[50:] == ["new"]
    left = run([("later", "2024-01-02 00:00:00")], "c")
    assert seen[51:] == ["later"] and min(left) <= 2  # the links of the first day are gone from the state


def test_target_keeps_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FAN", 2)
    monkeypatch.setattr(T, "BUCKETS", 2)
    target, ddl = str(tmp_path / "ads"), "source_url string, pos int"
    for n in range(9):
        batch = spark.createDataFrame([(f"u{n}", n), (f"u{n // 2}", n)], ddl)
        U.insert_batch(batch, n, target)
        assert len(T.folders(spark, target)) <= 2 + n.bit_length()
    assert sorted(tuple(r) for r in T.read_rows(spark, target, ddl).collect()) == [(f"u{n}", n) for n in range(9)]
    assert T.read_rows(spark, target, ddl, before=3).count() <= 3
    # a batch that is run again replaces what it wrote, and does not meet itself
    U.insert_batch(spark.createDataFrame([("u8", 8), ("other", 8)], ddl), 8, target)
    assert {r.source_url for r in T.read_rows(spark, target, ddl).collect()} == {*(f"u{n}" for n in range(9)), "other"}
    # what a stop leaves beside a longer folder is passed over, then goes
    T._read(spark, target, ddl, T.folders(spark, target)[-1:]).where("pos = 0").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/span=0-0-0")
    assert T.read_rows(spark, target, ddl).count() == 10
    T.fold(spark, target, ddl, 9)
    assert not (tmp_path / "ads" / "rows" / "span=0-0-0").exists()


def test_folders_of_many_batches(spark, tmp_path):
    """A thousand batches leave FAN folders a level at most: the names alone decide."""
    live = []
    for n in range(1000):
        live.append((0, n, n))
        level = 0
        while len(full := [f for f in live if f[0] == level]) >= T.FAN:
            live = [f for f in live if f[0] != level] + [(level + 1, full[0][1], full[-1][2])]
            level += 1
    for f in live:
        (tmp_path / "rows" / "span={}-{}-{}".format(*f)).mkdir(parents=True)
        (tmp_path / "rows" / "span={}-{}-{}".format(*f) / "_SUCCESS").touch()
    assert T.folders(spark, str(tmp_path)) == sorted(live) and len(live) <= 4 * T.FAN


def test_unit_stopped_anywhere(spark, tmp_path, monkeypatch):
    """A unit that stops after any of its writes and is run again gives the tables of one that never stopped."""
    from adloom.plans import messages as M

    ups = "update_id long, message struct<message_id: long, text: string, chat: struct<id: long>>"
    batches = [[(1, (1, "https://x.y/a https://x.y/none", (7,))), (2, (1, "https://x.y/a", (8,)))], [(2, None), (3, (2, "https://x.y/b https://x.y/a", (7,))), (1, (9, "https://x.y/b", (7,)))]]
    asked = []

    def fetch(links):
        asked.append(1)
        return links.where("url not like '%none'").selectExpr("url requested_url", "url final_url", "'<h1>Cook</h1>' body")

    def tables_of(target):
        names = {"links": M.LINKS, "results": M.RESULTS, "outcomes": M.OUTCOMES, "commits": M.COMMITS}
        out = {n: sorted(map(str, T.read_table(spark, target, n, d).collect())) for n, d in names.items()}
        return out | {"ads": sorted(map(str, T.read_rows(spark, target, M.ADS).collect()))}

    def unit(target, n):
        M.message_unit(spark.createDataFrame(batches[n], ups), n, 7, fetch, target)

    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    for n in (0, 1):
        unit(whole, n)
    assert len(asked) == 2
    unit(broken, 0)
    put = T.put
    for stop in ("links", "outcomes", "commits"):
        def stopping(df, target, name, number, stop=stop):
            if name == stop:
                raise InterruptedError(name)
            put(df, target, name, number)

        monkeypatch.setattr(T, "put", stopping)
        try:
            unit(broken, 1)
            raise AssertionError("not stopped")
        except InterruptedError:
            pass
        monkeypatch.setattr(T, "put", put)
        assert T.committed(spark, broken) == [0] and len(tables_of(broken)["results"]) == 2
    unit(broken, 1)
    assert tables_of(broken) == tables_of(whole)
    ends = {r.last_update_id: (r.messages_checked, r.links_found, r.links_scraped, r.errors) for r in T.read_table(spark, whole, "commits", M.COMMITS).collect()}
    assert ends == {2: (1, 2, 1, 1), 3: (1, 2, 1, 0)}


def test_messages_under_one_id(spark, tmp_path):
    """Every message of an id counts and is read; one that is told again counts once."""
    from adloom.plans import messages as M

    ups = [(1, (1, "https://x.y/none https://x.y/a", (7,))), (1, (2, "https://x.y/b https://x.y/none", (7,))), (1, (2, "https://x.y/b", (7,))), (1, (3, "https://x.y/c", (8,))), (2, None), (2, None)]
    batch = spark.createDataFrame([*ups[:2], *ups[1:2], *ups[3:]], tables.UPDATE)
    fetch = lambda links: links.where("url not like '%none'").selectExpr("url requested_url", "url final_url", "'<h1>Cook</h1>' body")
    M.message_unit(batch, 0, 7, fetch, str(tmp_path))
    results = sorted(map(tuple, T.read_table(spark, str(tmp_path), "results", M.RESULTS).collect()))
    assert results == [(1, "https://x.y/a", True, True), (1, "https://x.y/b", True, True), (1, "https://x.y/none", False, False)]
    assert [tuple(r) for r in T.read_table(spark, str(tmp_path), "commits", M.COMMITS).collect()] == [(2, 3, 2, 1, 2)]
    again = U.told_once(spark.createDataFrame(ups, tables.UPDATE))
    assert sorted((r.update_id, r.message and r.message.message_id or 0) for r in again.collect()) == [(1, 1), (1, 2), (1, 3), (2, 0)]


def test_handler_is_asked_once(spark, tmp_path):
    ups = spark.createDataFrame([(1, (1, "https://x.y/a", (7,)))], "update_id long, message struct<message_id: long, text: string, chat: struct<id: long>>")
    calls = spark.sparkContext.accumulator(0)

    def note(parts):
        for pdf in parts:
            calls.add(len(pdf))
            yield pdf

    results = U.message_links(ups).selectExpr("update_id", "url", "true ok", "true inserted").mapInPandas(note, "update_id long, url string, ok boolean, inserted boolean")
    U.check_batch(ups, 0, results, str(tmp_path))
    assert calls.value == 1


def test_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"update_id": 1}\n\n{"update_id": 2, \n[]\n{"update_id": null}\n{"update_id": 3, "message": "text"}\nnull')
    read = lambda df: df.writeStream.format("memory").queryName("lines").trigger(availableNow=True).start().awaitTermination() or spark.table("lines").collect()
    assert {r.update_id for r in read(tables.read_updates(spark, str(tmp_path / "in")))} >= {1}
    assert sorted((r.line, r.reason) for r in read(tables.dead_letters(spark, str(tmp_path / "in"))))[:2] == [("[]", "no update id"), ("null", "no update id")]
