import json

from pyspark.sql import functions as F

from adloom.functions.text import cleanup_text
from adloom.operators.adapters import fill_with, parse_pages, register_adapter
from adloom.sources import payload
from adloom.sources.html import facts, parse, with_breaks

UUID = "0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"
SEEK_LIST = """<article data-automation=normalJob><a data-automation=job-list-view-job-link href="/id/job/11?ref=1#x"></a><a data-automation=jobTitle>Bridge
 Painter</a><span data-automation=jobCompany>PT Satu</span><span data-automation=jobSalary>Rp&nbsp;5 – Rp 7 per month</span></article>
<article data-automation=normalJob><a href="/about">x</a><a href="https://id.jobstreet.com/id/job/22/">Two</a></article>
<article data-automation=normalJob><a data-automation=job-list-view-job-link href="/id/job/11"></a></article>
<a rel="nofollow next" aria-hidden="true" href="?page=9">no</a><a rel="nofollow next" href="?page=2">next</a>"""
SEEK_DETAIL = """<h1 data-automation=job-detail-title>Stage — Light</h1><span data-automation=advertiser-name>PT. A</span>
<div data-automation=jobAdDetails><p>Hello<br>you<ul><li>one<li>• two</li><li> <p>three</p></li></ul></div>"""
GLINTS_LIST = f"""<div data-gtm-job-id=1 data-gtm-company-name="Blue Door"><a href="/id/opportunities/jobs/welder/{UUID}?x=1"><h2 class=xJobTitle>Ship Welder</h2></a></div>
<div data-gtm-job-id=2><a href="/id/opportunities/jobs/explore/{UUID}">x</a></div>"""
GLINTS_DETAIL = """<h1>Lock Keeper</h1><button data-gtm-company-name="PT. B">b</button><div class=JobOverviewX><span class=SalaryX>Rp 4,100,000 - 6,200,000 / Month</span><span class=SalaryBig>Salary: Rp 4,100,000 - 6,200,000 / Month</span></div>
<div class="JobDescriptionsc__DescriptionContainer-a">Text<div>more</div></div>"""


def _next(data):
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


def _queries(*qs):
    return {"props": {"pageProps": {"dehydratedState": {"queries": [{"queryKey": [k, {"a": 1}], "state": {"data": d}} for k, d in qs]}}}}


JOB = {"role": "Night  Nurse", "slug": "night-nurse", "salaryType": "paid", "salaryRange": {"start": 3200000, "end": 4100000}, "responsibilities": "<ul><li>do</li></ul>", "requirements": "<p>be</p>", "company": {"name": "Lentera", "slug": "fin"}}
KAL = {"id": 5150, "name": "Map Drawer", "slug": "map-drawer", "companyName": "PT C", "description": "<p>d</p>", "qualifications": "<li>q", "baseSalary": 2500000.0, "maximumSalary": 2600000, "salaryInterval": "month", "salaryShown": True, "company": {"code": "pt-c", "name": "x"}}
THREADS = """<meta property="og:description" content="Now hiring | Harbour Pilot&#10;Join Kopi Lentera Pte Ltd"><meta property="og:url" content="https://www.threads.com/@a/post/Z">
<script>{"plaintext":"Now hiring | Harbour Pilot\\nJoin Kopi Lentera Pte Ltd in town. Pay: SGD 20/hour"} {"plaintext":"%s"}</script>""" % ("decoy " * 30)
STATIC = "<title>t</title><meta property=og:site_name content=' Site '><h1>Cook</h1><article>" + "We need a cook. " * 5 + "Salary: USD 5k per month</article>"
LINKS = "".join(f'<a href="/jobs/{i}">Job {i}</a>' for i in (1, 2, 2, 3)) + '<a href="#x">x</a><a href="mailto:a">m</a><a href="/careers/9"></a>'
PAGES = [
    ("https://id.jobstreet.com/jobs", SEEK_LIST), ("https://id.jobstreet.com/job/41?ref=1#a", SEEK_DETAIL), ("https://id.jobstreet.com/job/42", "<p>none"),
    ("https://glints.com/id/explore", GLINTS_LIST), (f"https://glints.com/id/opportunities/jobs/lock-keeper/{UUID}", GLINTS_DETAIL),
    ("https://dealls.com/loker/night-nurse~fin", _next(_queries(("/v1/other", {}), ("x/v1/job-portal/job/slug/a", JOB)))),
    ("https://dealls.com/loker/dom~fin", "<h1>Dom Job</h1><h2>H2 Co</h2><span>Rp 5.000.000 sampai</span><span>Rp 5</span><div><h3>Deskripsi Pekerjaan</h3><div><p>text</div></div>"),
    ("https://dealls.com/?searchJob=x", _next(_queries(("/v1/explore-job/job", {"pages": [{"docs": [JOB, JOB, {**JOB, "slug": "saved"}]}]})))),
    ("https://dealls.com/?searchJob=y", '<div id=jobs-container><a href="/loker/a~b"><h3>A</h3>noise</a><a href="/loker/saved~b">s</a></div>'),
    ("https://www.kalibrr.id/c/pt-c/jobs/5150/map-drawer", _next({"props": {"pageProps": {"job": KAL}}})),
    ("https://www.threads.net/@a/post/Z?x=1", THREADS), ("https://www.threads.net/@a/post/Y", "<p>none"),
    ("https://example.com/jobs", LINKS), ("https://example.com/cook", STATIC), ("https://example.com/empty", None),
]


def test_parse_pages(spark):
    df = spark.createDataFrame([(u, u, b) for u, b in PAGES], "requested_url string, final_url string, body string")
    rows = parse_pages(df).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.requested_url, r.pos if r.pos is not None else -1)):
        by.setdefault(r.requested_url, []).append(r)
    ads = {u: [(r.source_url, r.title, r.company, r.salary, r.description) for r in rs if r.error is None] for u, rs in by.items()}
    u = [p[0] for p in PAGES]
    assert ads[u[0]] == [("https://id.jobstreet.com/id/job/11", "Bridge Painter", "PT Satu", "Rp 5 – Rp 7 per month", ""), ("https://id.jobstreet.com/id/job/22", "x", "", "Salary Undisclosed", "")]
    assert by[u[0]][0].next_url == "https://id.jobstreet.com/jobs?page=2" and by[u[0]][0].kind == "listing"
    assert ads[u[1]] == [("https://id.jobstreet.com/job/41", "Stage — Light", "PT. A", "Salary Undisclosed", "Hello\nyou\n• one\n• two\n• three")]
    assert ads[u[2]] == [] and by[u[2]][0].error
    assert ads[u[3]] == [(f"https://glints.com/id/opportunities/jobs/welder/{UUID}", "Ship Welder", "Blue Door", "Salary Undisclosed", "")]
    assert ads[u[4]] == [(u[4], "Lock Keeper", "PT. B", "Rp 4,100,000 - 6,200,000 / Month", "Text\nmore")]
    assert ads[u[5]] == [(u[5], "Night Nurse", "Lentera", "Rp3.200.000 – Rp4.100.000", "Deskripsi Pekerjaan\n• do\n\nKualifikasi\nbe")]
    assert ads[u[6]] == [(u[6], "Dom Job", "H2 Co", "Rp 5", "Deskripsi Pekerjaan\ntext")]
    assert ads[u[7]] == [("https://dealls.com/loker/night-nurse~fin", "Night Nurse", "Lentera", "Rp3.200.000 – Rp4.100.000", "")]
    assert ads[u[8]] == [("https://dealls.com/loker/a~b", "A", "", "Negotiable", "")]
    assert ads[u[9]] == [("https://www.kalibrr.id/id-ID/c/pt-c/jobs/5150/map-drawer", "Map Drawer", "PT C", "Rp2.500.000 – Rp2.600.000 / bulan", "Deskripsi Pekerjaan\nd\n\nKualifikasi Minimum\n• q")]
    assert ads[u[10]] == [("https://www.threads.com/@a/post/Z", "Harbour Pilot", "Kopi Lentera Pte Ltd", "Pay: SGD 20/hour", "Now hiring | Harbour Pilot\nJoin Kopi Lentera Pte Ltd in town. Pay: SGD 20/hour")]
    assert ads[u[11]] == [] and by[u[11]][0].error
    assert [(a[0], a[1]) for a in ads[u[12]]] == [("https://example.com/jobs/1", "Job 1"), ("https://example.com/jobs/2", "Job 2"), ("https://example.com/jobs/3", "Job 3"), ("https://example.com/careers/9", "https://example.com/careers/9")]
    assert ads[u[13]][0][1:4] == ("Cook", "Site", "Salary: USD 5k per month")
    assert ads[u[14]] == [(u[14], u[14], "", "", "")]


def test_breaks(col):
    rows = ["<div>a<script>x</script><p>b</p>c</div>", "<ul><li> <p>x</p></li><li>- y</li></ul>", "a<br><br><br>b", ""]
    got = col(cleanup_text, [with_breaks(parse(r)) for r in rows], "a string")
    assert got == ["a\nb\nc", "• x\n- y", "a\n\nb", ""]


def test_tolerance():
    f = facts("<body><p><b>x<p>y</b></i><h1>T</h1><a href=//h/p rel=next>l</a><script>var t='</p>'</script>", "https://a.b/c/")
    assert f["h1"] == "T" and f["links"][0]["url"] == "https://h/p"
    assert payload.plaintexts(r'{"plaintext":"a\nb"} {"plaintext":"c\/d"} {"plaintext" : "é\""}') == ["a\nb", 'é"']


def test_api_pages(spark):
    body = lambda **x: json.dumps({"code": 200, "data": {"docs": [JOB], "page": 2, "totalPages": 3}} | x)
    df = spark.createDataFrame([(1, body()), (2, body(code=500)), (3, "{bad"), (4, body(code="x")), (5, body(data={"docs": [], "totalPages": 1}))], "n int, body string")
    got = {r.n: (r.ok, r.total_pages, [a.source_url for a in r.ads or []]) for r in payload.dealls_api_ads(df).collect()}
    assert got[1] == (True, 3, ["https://dealls.com/loker/night-nurse~fin"]) and [got[k][0] for k in (2, 3, 4, 5)] == [False, False, False, True]
    snake = {"id": 5, "name": "N", "slug": "n", "company_name": 7, "base_salary": "12", "maximum_salary": 9.9, "salary_shown": "no", "company_info": {"code": "c", "name": "Co"}}
    df = spark.createDataFrame([(1, json.dumps({"count": 30, "jobs": [snake, {"name": "no id"}]})), (2, "["), (3, "[]")], "n int, body string")
    got = {r.n: r for r in payload.kalibrr_api_ads(df).collect()}
    assert (got[1].ok, got[1]["count"]) == (True, 30) and not got[2].ok and not got[3].ok
    assert [(a.source_url, a.company, a.salary) for a in got[1].ads] == [("https://www.kalibrr.id/id-ID/c/c/jobs/5/n", "Co", "Rp9")]


def test_own_adapter_and_extractor(spark):
    from adloom.operators import adapters

    register_adapter("mine", lambda df: df.withColumn("ads", F.expr("array(named_struct('source_url', final_url, 'title', 'T', 'company', '', 'salary', '', 'description', 'd'))")))
    try:
        df = spark.createDataFrame([("http://m/1", "http://m/1", "x", "mine"), ("http://m/2", "http://m/2", "<h1>S</h1>", "static")], "requested_url string, final_url string, body string, adapter string")
        rows = sorted((r.source_url, r.title) for r in parse_pages(df).collect())
        assert rows == [("http://m/1", "T"), ("http://m/2", "S")]
    finally:
        adapters._OWN.clear()
    ads = spark.createDataFrame([("a", "T", "", "", "text"), ("b", "", "C", "s", "boom"), ("c", "T", "C", "s", "x")], "source_url string, title string, company string, salary string, description string")
    calls = lambda text, missing: (_ for _ in ()).throw(ValueError()) if text == "boom" else ("no", " Filled ", "")
    got = {r.source_url: (r.title, r.company, r.salary) for r in fill_with(ads, calls).collect()}
    assert got == {"a": ("T", "Filled", ""), "b": ("", "C", "s"), "c": ("T", "C", "s")}


def test_deep_pages():
    """Tag soup of any depth is read in time, and text keeps its order."""
    f = facts("<body>" + "<b><div>" * 30_000 + "<p>a<li>deep" + "<p>x" * 5_000, "https://a.b/")
    assert f["error"] is None if "error" in f else True
    assert with_breaks(parse("<ul>" + "<li><ul>" * 400 + "x" + "</ul>" * 400 + "<li>y</ul>")).replace("\n", "").replace("• ", "") == "xy"
