import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adloom.operators import ingest, listing, review
from adloom.sources import tables

CARD = "source_id long, page_no int, pos int, source_url string"


def _cards(rows):
    return [(s, p, i, u) for s, p, us in rows for i, u in enumerate(us)]


def _walk(rows, mode, ends, cap=100, size=15):
    """The walk in plain Python, one source."""
    cards = {}
    for _, p, _, u in rows:
        cards.setdefault(p, []).append(u)
    out, seen, n = [], set(), 0
    total = ends.get(0, {}).get("count", 0)
    while True:
        p = n * size if mode == "offset" else n + 1
        e = ends.get(p)
        if e is None or mode != "link" and not e["ok"] or mode == "offset" and p and p >= total:
            return out
        new = [u for u in dict.fromkeys(cards.get(p, [])) if u not in seen]
        if not new:
            return out
        seen |= set(new)
        out = (out + new)[:cap]
        if len(out) == cap or mode == "link" and not e["has_next"] or mode == "pages" and p > 1 and p >= e["total_pages"]:
            return out
        n += 1


@pytest.mark.parametrize("mode", ["link", "pages", "offset"])
def test_listing_prefix_is_the_walk(spark, mode):
    rng = random.Random(3)
    schema = {"link": "has_next boolean", "pages": "ok boolean, total_pages int", "offset": "ok boolean, count int"}[mode]
    cards, pages, want = [], [], {}
    for source in range(40):
        own, ends = [], {}
        for k in range(rng.randint(0, 5)):
            p = k * 15 if mode == "offset" else k + 1
            if rng.random() < 0.1:
                continue
            e = {"link": {"has_next": rng.random() < 0.9}, "pages": {"ok": rng.random() < 0.95, "total_pages": rng.randint(1, 5)}, "offset": {"ok": rng.random() < 0.95, "count": rng.choice([2, 20, 30, 100])}}[mode]
            ends[p] = e
            own += [(source, p, i, f"u{rng.randint(0, 12)}") for i in range(rng.randint(0, 4))]
            pages.append((source, p, *e.values()))
        cards += own
        want[source] = _walk(own, mode, ends, cap=6)
    got = listing.listing_prefix(spark.createDataFrame(cards, CARD), spark.createDataFrame(pages, f"source_id long, page_no int, {schema}"), mode, cap=6).collect()
    by = {s: [r.source_url for r in sorted((r for r in got if r.source_id == s), key=lambda r: (r.page_no, r.pos))] for s in want}
    assert by == want and any(want.values())


def test_listing_caps(spark):
    cards = _cards([(1, 1, [f"a{i}" for i in range(60)]), (1, 2, [f"b{i}" for i in range(60)])])
    pages = spark.createDataFrame([(1, 1, True), (1, 2, True)], "source_id long, page_no int, has_next boolean")
    kept = listing.listing_prefix(spark.createDataFrame(cards, CARD), pages)
    assert kept.count() == 100
    assert [r.source_id for r in listing.listing_errors(spark.createDataFrame([(1,), (2,)], "source_id long"), kept).collect()] == [2]


def test_insert_if_new_is_idempotent(spark):
    old = spark.createDataFrame([("a",)], "source_url string")
    rows = [(2, 1, 0, "b"), (1, 1, 1, "b"), (1, 1, 0, "a"), (3, 1, 0, "c"), (None, 1, 0, "c")]
    new, skipped = ingest.insert_if_new(old, spark.createDataFrame(rows, CARD))
    assert sorted((r.source_url, r.source_id) for r in new.collect()) == [("b", 1), ("c", None)] and skipped.count() == 3
    assert ingest.new_ads(old, spark.createDataFrame(rows, CARD)).count() == 2
    twice, rest = ingest.insert_if_new(old, spark.createDataFrame([(1, 1, 0, "t")] * 5, CARD))
    assert twice.count() == 1 and rest.count() == 4
    again, _ = ingest.insert_if_new(old.union(new.select("source_url")), spark.createDataFrame(rows, CARD))
    assert again.count() == 0


def test_enrich_pick_fill(spark):
    ad = "source_url string, title string, company string, salary string, description string"
    stubs = spark.createDataFrame([(1, "u1", "S1", "C", "s", ""), (1, "u2", "S2", "C", "s", ""), (1, "u3", "S3", "C", "s", "")], "source_id long, " + ad)
    details = spark.createDataFrame([("u1", "f1", "D1", "", "", ""), ("u2", None, None, None, None, None)], "requested_url string, " + ad)
    assert sorted((r.source_url, r.title, r.company) for r in ingest.enrich(stubs, details).collect()) == [("f1", "D1", ""), ("u2", "S2", "C"), ("u3", "S3", "C")]
    cands = spark.createDataFrame([("r", 0, "x", "X", "", "", ""), ("r", 1, "r", "R", "", "", ""), ("q", 0, "y", "Y", "", "", ""), ("p", 0, "z", "Z", "", "", "long"), ("o", 0, "w", "W", "", "", "")], "requested_url string, pos int, " + ad)
    static = spark.createDataFrame([("q", "ST", "", "", "d"), ("p", "no", "", "", "")], "requested_url string, title string, company string, salary string, description string")
    got = {r.requested_url: (r.source_url, r.title) for r in ingest.pick_requested(cands, static).collect()}
    assert got == {"r": ("r", "R"), "q": ("q", "ST"), "p": ("z", "Z"), "o": ("w", "W")}


def test_pick_of_one_place(spark):
    """Of several ads at one place the same is picked, in whatever order they come."""
    ad = "requested_url string, pos int, source_url string, title string, company string, salary string, description string"
    rows = [("r", 0, "x", "T", "", "", d) for d in ("n", "", "r")] + [("q", 1, u, "T", "", "", "d") for u in ("y", "x")] + [("q", 2, "a", "T", "", "", "d")]
    static = spark.createDataFrame([("r", "ST", "", "", "static")], "requested_url string, title string, company string, salary string, description string")
    for given in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = ingest.pick_requested(spark.createDataFrame(given, ad).coalesce(1), static).select("requested_url", "source_url", "title", "description")
        assert sorted(map(tuple, got.collect())) == [("q", "x", "T", "d"), ("r", "r", "ST", "static")]


def test_upsert_and_ids(spark):
    base = spark.createDataFrame([("k", "old"), ("z", "stay")], "key string, value string")
    changes = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("n", "c", 1)], "key string, value string, at int")
    got = ingest.upsert(base.withColumn("at", F.lit(0)), changes, ["key"], ["at"])
    assert sorted((r.key, r.value) for r in got.collect()) == [("k", "b"), ("n", "c"), ("z", "stay")]
    two = spark.createDataFrame([(k % 2, str(k)) for k in range(300)], "a int, b string")
    got = ingest.assign_ids(two, 0, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.id)] == sorted((k % 2, str(k)) for k in range(300)) and sorted(r.id for r in got) == list(range(1, 301))
    ids = ingest.assign_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("n")), 50, ["n"]).orderBy("n").collect()
    assert [r.id for r in ids] == list(range(51, 1051))
    assert ingest.assign_ids(spark.createDataFrame([], "n long"), 0, ["n"]).count() == 0


def test_plan_and_summary(spark):
    s = spark.createDataFrame([(1, "static", True), (2, "telegram", True), (3, "who", True), (4, "static", False)], "id long, adapter string, enabled boolean")
    assert {r.id: r.action for r in ingest.crawl_plan(s).collect()} == {1: "crawl", 2: "skip", 3: "error"}
    res = spark.createDataFrame([("r", 1, "source"), ("r", 2, "source"), ("r", 1, "new"), ("r", 1, "skipped"), ("r", 2, "error")], "run string, source_id long, outcome string")
    got = {(r.level, r.source_id): (r.sources, r.new_ads, r.skipped, r.errors) for r in ingest.crawl_summary(res).collect()}
    assert got == {("run", None): (2, 1, 1, 1), ("source", 1): (1, 1, 1, 0), ("source", 2): (1, 0, 0, 1)}


@pytest.fixture(scope="module")
def ads(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 2 else 9, f"u{i}", f"T{i}", "new" if i % 3 else "applied", t + dt.timedelta(days=i // 2)) for i in range(1, 8)]
    return spark.createDataFrame(rows, "id long, source_id long, source_url string, title string, status string, scraped_at timestamp")


def test_lists(spark, ads):
    sources = spark.createDataFrame([(1, "S")], "id long, name string")
    page = review.list_ads(ads, sources, "all", 3, 1).collect()
    assert sorted((r.id for r in page), reverse=True) == [6, 5, 4] and {r.source_name for r in page} == {"", "S"}
    assert [r.id for r in review.list_ads_after(ads, "all", (dt.datetime(2024, 1, 4), 6), 2).collect()] == [5, 4]
    assert review.list_ads(ads, sources, "all", 0).count() == 0 and review.filter_status(ads, "nope").count() == 0 and review.filter_status(ads, None).count() == 5
    assert {r.status: r.n for r in review.status_counts(ads).collect()} == {"all": 7, "new": 5, "applied": 2}
    info = lambda s, p: tuple(review.page_info(ads, s, p, 3).first())
    assert info("all", 9) == (7, 3, 3) and info("all", -1) == (7, 3, 1) and info("nope", 5) == (0, 0, 1)
    links = spark.createDataFrame([("new", 1), ("applied", 2), ("", 1)], "s string, p int").select(review.page_link(F.col("s"), F.col("p")).alias("x")).collect()
    assert [r.x for r in links] == ["/?status=new", "/?status=applied&page=2", "/?status=new"]


def test_bulk(spark, ads):
    changes = spark.createDataFrame([(1, "rejected", 1), (1, "applied", 2), (2, "bad", 3), (99, "ignored", 4)], "id long, status string, at int")
    after = {r.id: r.status for r in review.apply_status(ads, changes, ("at",)).collect()}
    assert after[1] == "applied" and after[2] == "new" and len(after) == 7
    assert [r.id for r in review.unknown_ids(ads, changes).collect()] == [99]
    letters = spark.createDataFrame([(1, 1, "a", dt.datetime(2024, 1, 1)), (2, 1, "b", dt.datetime(2024, 1, 1)), (3, 5, "c", dt.datetime(2024, 1, 1)), (4, 77, "d", None)], "id long, job_ad_id long, content string, created_at timestamp")
    left, kept = review.delete_ads(ads, letters, spark.createDataFrame([(1,), (1,)], "id long"))
    assert left.count() == 6 and sorted(r.id for r in kept.collect()) == [3, 4]
    assert {r.job_ad_id: r.content for r in review.latest_letter(letters).collect()} == {1: "b", 5: "c", 77: "d"}
    assert [r.id for r in review.letter_ranks(letters).where("job_ad_id = 1").orderBy("rank").collect()] == [2, 1]
    assert [r.id for r in review.letters_of(ads, letters).collect()] == [2, 1, 3]
    assert [r.id for r in review.orphans(letters, ads, "job_ad_id").collect()] == [4]
    bad = spark.createDataFrame([(1, "", "t", "new"), (2, "u", None, "odd"), (3, "u", "t", "new")], "id long, source_url string, title string, status string")
    assert sorted(tuple(r) for r in review.violations(bad).collect()) == [(1, "source_url"), (2, "status"), (2, "title")]


def test_tables(spark, tmp_path, ads):
    pages = spark.createDataFrame([(1, 1, 1, "u", None, 200, "b"), (2, 1, 2, "v", "w", 404, "b"), (3, 1, 3, "x", "y", 204, "b")], "page_id long, source_id long, page_no int, requested_url string, final_url string, http_status int, body string")
    pages.write.parquet(str(tmp_path / "pages"))
    assert sorted(r.final_url for r in tables.read_pages(spark, str(tmp_path / "pages")).collect()) == ["u", "y"]
    (tmp_path / "api").mkdir()
    (tmp_path / "api/a.json").write_text('{"count": 1,\n "jobs": []}')
    (tmp_path / "api/b.json").write_text("{bad")
    assert sorted(r.ok for r in tables.read_api_pages(spark, str(tmp_path / "api")).collect()) == [False, True]
    full = ads.select("id", "source_id", "source_url", "title", F.lit("").alias("company"), F.lit("").alias("salary"), F.lit("").alias("description"), F.lit(None).cast("timestamp").alias("posted_at"),
                      F.when(F.col("id") == 1, None).otherwise(F.col("scraped_at")).alias("scraped_at"), F.when(F.col("id") == 2, "").otherwise(F.col("status")).alias("status"))
    tables.write_ads(full, str(tmp_path / "ads"))
    got = {r.id: r for r in tables.read_ads(spark, str(tmp_path / "ads")).collect()}
    assert len(got) == 7 and got[1].scraped_at is not None and got[2].status == "new"
    p = spark.createDataFrame([("skills", "x"), ("full_name", "y"), (None, "z")], "key string, value string")
    assert tables.profile_map(p).first().profile == {"full_name": "y", "skills": "x"}
    assert [r.key for r in tables.list_profile(p.where("key is not null")).collect()] == ["full_name", "skills"]
    s = spark.createDataFrame([(2, "https://dealls.com/?searchJob=a%20b", "dealls", True), (1, "https://www.kalibrr.id/home/te/x", "kalibrr", True), (3, "http://s", "static", False)], "id long, url string, adapter string, enabled boolean")
    f = {(r.source_id, r.page_no): r.page_url for r in tables.frontier(s, 3).collect()}
    assert len(f) == 7 and "page=3&published=true&search=a+b" in f[2, 3] and f[1, 2].endswith("offset=15&text=x") and f[3, 1] == "http://s"
    assert [r.id for r in tables.list_sources(s, True).collect()] == [1, 2]


def test_only_glints_listings_are_capped(spark):
    from adloom.plans.crawl import _single_rows

    rows = [(1, "static", "listing", 1, k, f"s{k}") for k in range(130)] + [(2, "glints", "listing", 1 + k // 90, k % 90, f"g{k % 60 if k < 90 else k}") for k in range(180)]
    out = _single_rows(spark.createDataFrame(rows, "source_id long, adapter string, kind string, page_no int, pos int, source_url string")).collect()
    assert {r.source_url for r in out if r.source_id == 1} == {f"s{k}" for k in range(130)}
    assert sorted(r.source_url for r in out if r.source_id == 2) == sorted([f"g{k}" for k in range(60)] + [f"g{k}" for k in range(90, 130)])
