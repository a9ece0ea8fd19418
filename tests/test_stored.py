"""Stored tables: only parts with changed keys are rewritten, reruns give one result; dot segments; parts of pages."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from adloom.functions import urls
from adloom.operators import adapters
from adloom.sources import html, stored, tables

DDL = "id bigint, status string"


def _files(path):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in path.glob("part=*/*.parquet")}


def test_change_touches_only_its_parts(spark, tmp_path):
    path = tmp_path / "ads"
    stored.create(spark.range(200).select("id", F.lit("new").alias("status")), str(path), "id", 16)
    before = _files(path)
    changes = spark.createDataFrame([(3, "applied", 1), (3, "ignored", 2), (4, "odd", 1), (900, "applied", 1)], "id long, status string, at long")
    touched = stored.set_status(spark, str(path), DDL, changes, ("at",), 16)
    after = _files(path)
    assert {k for k in after if after[k] != before.get(k)} <= {f"part={p}" for p in touched} and len(touched) <= 3
    got = {r.id: r.status for r in stored.read(spark, str(path), DDL).collect()}
    assert got == {k: "ignored" if k == 3 else "new" for k in range(200)}
    assert stored.set_status(spark, str(path), DDL, changes, ("at",), 16) == touched  # again: the same
    assert {r.id: r.status for r in stored.read(spark, str(path), DDL).collect()} == got
    assert stored.set_status(spark, str(path), DDL, changes.limit(0), ("at",), 16) == []
    old = spark.read.schema(f"{DDL}, part int").parquet(str(path)).where(F.col("part").isin(touched))
    assert "PartitionFilters: [isnotnull(part" in old._jdf.queryExecution().executedPlan().toString() or "part#" in old._jdf.queryExecution().executedPlan().toString()


def test_delete_whole_parts(spark, tmp_path):
    ads, letters = str(tmp_path / "ads"), str(tmp_path / "letters")
    stored.create(spark.range(20).select("id", F.lit("new").alias("status")), ads, "id", 8)
    stored.create(spark.range(20).selectExpr("id as job_ad_id", "id + 100 as id"), letters, "job_ad_id", 8)
    ids = spark.range(19).union(spark.range(500, 502))
    for _ in range(2):
        stored.delete(spark, (ads, DDL), (letters, "job_ad_id bigint, id bigint"), ids, 8)
        assert [r.id for r in stored.read(spark, ads, DDL).collect()] == [19]
        assert [r.id for r in stored.read(spark, letters, "job_ad_id bigint, id bigint").collect()] == [119]
    assert len(list((tmp_path / "ads").glob("part=*"))) == 1


def test_upsert(spark, tmp_path):
    path, ddl = str(tmp_path / "profile"), "key string, value string"
    stored.create(spark.createDataFrame([("a", "1"), ("b", "2")], ddl), path, "key", 4)
    changes = spark.createDataFrame([("b", "3"), ("c", "4")], ddl)
    for _ in range(2):
        stored.upsert(spark, path, ddl, "key", changes, ["value"], 4)
        assert {r.key: r.value for r in stored.read(spark, path, ddl).collect()} == {"a": "1", "b": "3", "c": "4"}


def test_links_as_urljoin(spark):
    bases = ["http://h.i/a/b/c?q=1#f", "http://h.i", "http://h.i/", "https://h.i/a/", "http://h.i/a//b/c"]
    hrefs = ["", "x", "./x", "../x", "../../x", "../../../x", "../../../../x", "x/..", "x/../", "x/.", "./", "../", "..", ".", "/a/../b", "/../x", "/a/./b/", "?q", "#z", "x?y=../z", "x#../z", "//o.p/../q", "http://z/../y", "/", "x//y", "/x//../y", "../x/./y?b#c"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", urls.resolve_url(F.col("b"), F.col("h")).alias("x")).collect()
    assert [(r.b, r.h, r.x) for r in got if r.x != urljoin(r.b, r.h)] == []


def test_facts_by_adapter(spark):
    """An adapter's facts are those of a page read for all."""
    page = ('<title>t</title><meta name="salary" content="5"><h1 class="JobTitle">One</h1><h2>two</h2><h3>Kualifikasi</h3><div><p>need</p></div><a href="/karir/x">Co</a><a href="../x" rel="next">n</a><main>' + "m" * 50 +
            '</main><article>short</article><div data-automation="normalJob"><a data-automation="job-list-view-job-link" href="/job/1">J</a></div><div data-gtm-job-id="1" data-gtm-company-name="G"><a href="/g">a</a><b class="Salary">Rp 1</b></div>'
            '<div id="jobs-container"><a href="/loker/a~b"><h3>L</h3></a></div><script id="__NEXT_DATA__">{"a": 1}</script>')
    whole = html.facts(page, "http://h.i/a/b")
    assert whole["h1"] == "One" and [b["selector"] for b in whole["bodies"]] == ["article", "main", "body"] and len(whole["dealls_sections"]) == 1
    for adapter, names in html.FACTS_OF.items():
        own = html.facts(page, "http://h.i/a/b", adapter)
        assert own == {n: whole[n] for n in ("links", *names)}
        assert set(html.facts(page, "http://h.i/a/b", adapter, "static")) == {"links", *names, *html.FACTS_OF["static"]}


def test_parts_of_pages(spark):
    rows = [("https://id.jobstreet.com/job/1", "<h1 data-automation=job-detail-title>A</h1>", None), ("https://x.y/z", "<h1>B</h1>", None), ("https://x.y/q", "<h1>C</h1>", "who"), ("https://x.y/n", None, None)]
    pages = spark.createDataFrame(rows, "requested_url string, body string, adapter string").withColumn("final_url", F.col("requested_url"))
    parts = adapters.read_facts(pages)
    assert {k: v.count() for k, v in parts.items()} == {"": 1, "jobstreet": 1, "static": 2}
    got = {r.requested_url: (r.adapter, r.title, r.error is None) for r in adapters.ads_of(parts).collect()}
    assert got == {"https://id.jobstreet.com/job/1": ("jobstreet", "A", True), "https://x.y/z": ("static", "B", True), "https://x.y/q": ("who", None, False), "https://x.y/n": ("static", "https://x.y/n", True)}
    none = adapters.parse_pages(pages.limit(0))
    assert none.count() == 0 and none.columns[:1] == ["requested_url"]


def test_shared_folder_of_the_context(spark, tmp_path):
    assert tables.new_folder(spark) != tables.new_folder(spark)


def test_both_readers_of_pages_agree(spark):
    """Whatever is read token by token gives the tree of the forgiving reader, and given pages are."""
    import random

    def tree(n):
        return n.tag, dict(n.attrs), [c if isinstance(c, str) else tree(c) for c in n.children]

    def forgiving(text):
        b = html._Builder()
        b.feed(text)
        b.close()
        return b.root

    bits = ["<", ">", "</", "<p", "<p>", "</p>", "<br/>", '<div class="a b">', "<a href='x'>", "<a href=x/>", "<a b c=d>", '"', "'", "=", " ", "\n", "&amp;", "&lt", "&#65;", "text", "<!-- c -->", "<!--", "-->", "-- >", "<!doctype html>",
            "<script>", 'var x="<p>";', "</script>", "</script >", "<style>", "</style>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "<input disabled>", '<A HREF="q" href="z">', '<x:y z="&quot;1">', "</ b>", "<![CDATA[x]]>", "<?pi?>", "<1>", "é", "\x00", "<textarea>"]
    rnd, plain = random.Random(4), 0
    for _ in range(8000):
        text = "".join(rnd.choices(bits, k=rnd.randint(1, 9)))
        root = html._plainly(text)
        if root is not None:
            plain += 1
            assert tree(root) == tree(forgiving(text)), text
    assert plain > 2000
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert tree(html._plainly(r.html)) == tree(forgiving(r.html))
