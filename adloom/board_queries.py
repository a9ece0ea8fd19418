"""Pages of the boards, made of the given tables' columns, through `parse_pages`; and the same ads as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.adapters import parse_pages
from adloom.queries import query


def filled(template: str, **values: Column) -> Column:
    """A text with `{name}` replaced by columns; null counts as empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _parsed(rows: DataFrame, url: Column, body: Column) -> DataFrame:
    """Ads of pages, keyed by p_partkey."""
    pages = rows.select("p_partkey", url.alias("requested_url"), url.alias("final_url"), body.alias("body"))
    ads = parse_pages(pages)
    return ads.select("p_partkey", F.col("pos").cast("long").alias("pos"), "kind", F.col("error").isNotNull().alias("failed"), "source_url", "title", "company", "salary", "description")


def _values(**more: Column) -> dict[str, Column]:
    names = {"k": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}
    return {a: F.col(b) for a, b in names.items()} | more


_SEEK_DETAIL = (
    '<html><body>{head}<span data-automation="advertiser-name">{brand}</span>{pay}<div data-automation="jobAdDetails"><p>Kind {type}</p>'
    "<ul><li>first {size}</li><li> <p>second</p></li><li>• third</li></ul><script>var x = 1;</script></div></body></html>"
)
_SEEK_CARD = '<article data-automation="normalJob"><a data-automation="job-list-view-job-link" href="/id/job/{k}?x=1"></a><a data-automation="jobTitle"> {name} </a><span data-automation="jobCompany">{brand}</span>{pay}</article>'
_SEEK_LIST = _SEEK_CARD + '<article data-automation="normalJob"><a href="/about">About {k}</a><a href="https://id.jobstreet.com/id/job/{next}/">x</a></article>' + _SEEK_CARD + "{more}"
_SEEK_PAY = "CASE WHEN p_size % 3 <> 0 THEN 'Rp ' || p_size || ' per month' ELSE 'Salary Undisclosed' END"


@query(f"""
SELECT p_partkey, CAST(0 AS BIGINT) AS pos, 'detail' AS kind, CAST(NULL AS VARCHAR) AS next_url, false AS failed, 'https://id.jobstreet.com/job/' || p_partkey AS source_url, p_name AS title, p_brand AS company, {_SEEK_PAY} AS salary,
    'Kind ' || p_type || chr(10) || '• first ' || p_size || chr(10) || '• second' || chr(10) || '• third' AS description FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, NULL, 'detail', NULL, true, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 0, 'listing', CASE WHEN p_partkey % 4 = 2 THEN 'https://id.jobstreet.com/jobs-' || p_partkey || '?page=2' END, false, 'https://id.jobstreet.com/id/job/' || p_partkey, p_name, p_brand, {_SEEK_PAY}, '' FROM part WHERE p_partkey % 4 >= 2
UNION ALL SELECT p_partkey, 1, 'listing', CASE WHEN p_partkey % 4 = 2 THEN 'https://id.jobstreet.com/jobs-' || p_partkey || '?page=2' END, false, 'https://id.jobstreet.com/id/job/' || (p_partkey + 1), 'About ' || p_partkey, '', 'Salary Undisclosed', '' FROM part WHERE p_partkey % 4 >= 2""")
def seek_pages(t, spark, sf):
    """Details, details without a title, listings with and without a next page."""
    k, has = F.col("p_partkey"), F.col("p_size") % 3 != 0
    pay = lambda tag: F.when(has, filled(f'<span data-automation="{tag}">Rp&nbsp;{{size}}  per month</span>', **_values()))
    detail = filled(_SEEK_DETAIL, **_values(pay=pay("job-detail-salary"), head=F.when(k % 4 == 0, filled('<h1 data-automation="job-detail-title"> {name} </h1>', **_values()))))
    more = F.when(k % 4 == 2, '<a rel="nofollow next" aria-hidden="true" href="?page=9">no</a><a rel="nofollow next" href="?page=2">more</a>')
    listing = filled(_SEEK_LIST, **_values(pay=pay("jobSalary"), next=k + 1, more=more))
    is_detail = k % 4 < 2
    url = F.when(is_detail, filled("https://id.jobstreet.com/job/{k}?ref=a#b", **_values())).otherwise(filled("https://id.jobstreet.com/jobs-{k}", **_values()))
    pages = t("part").select("p_partkey", url.alias("requested_url"), url.alias("final_url"), F.when(is_detail, detail).otherwise(listing).alias("body"))
    return parse_pages(pages).select("p_partkey", F.col("pos").cast("long").alias("pos"), "kind", "next_url", F.col("error").isNotNull().alias("failed"), "source_url", "title", "company", "salary", "description")


_UUID = "11111111-2222-3333-4444-"
_UUID_SQL = f"'{_UUID}' || lpad(CAST({{}} AS VARCHAR), 12, '0')"
_GLINTS_DETAIL = (
    '<h1>{name}</h1><button data-gtm-company-name=" {brand} ">x</button><div class="JobOverviewA">{pay}</div>'
    '<div class="JobDescriptionsc__DescriptionContainer-q">One {type}<div>two</div></div>'
)
_GLINTS_LIST = (
    '<div data-gtm-job-id="1" data-gtm-company-name="{brand}"><a href="/id/opportunities/jobs/a-b/{uuid}?x=1"><h2 class="xJobTitle">{name}</h2></a><div class="SalaryWrap">Rp {size}</div></div>'
    '<div data-gtm-job-id="2"><a href="/id/opportunities/jobs/explore/{uuid}">no ad</a></div>'
    '<div data-gtm-job-id="3"><a href="/opportunities/jobs/c/{other}">Anchor {k}</a><span data-cy="company_name_job_card">{type}</span></div>'
)


@query(f"""
SELECT p_partkey, CAST(0 AS BIGINT) AS pos, 'detail' AS kind, false AS failed, 'https://glints.com/id/opportunities/jobs/role-' || p_size || '/' || {_UUID_SQL.format("p_partkey")} AS source_url, p_name AS title, p_brand AS company,
    CASE p_size % 5 WHEN 0 THEN 'Salary undisclosed' WHEN 1 THEN 'Salary Undisclosed' ELSE 'Rp ' || p_size || ' / Month' END AS salary, 'One ' || p_type || chr(10) || 'two' AS description FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 0, 'listing', false, 'https://glints.com/id/opportunities/jobs/a-b/' || {_UUID_SQL.format("p_partkey")}, p_name, p_brand, 'Rp ' || p_size, '' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, 1, 'listing', false, 'https://glints.com/opportunities/jobs/c/' || {_UUID_SQL.format("p_partkey + 1")}, 'Anchor ' || p_partkey, p_type, 'Salary Undisclosed', '' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, NULL, 'listing', true, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 2""")
def glints_pages(t, spark, sf):
    """Details with several salary texts, listings, pages without cards."""
    k, size = F.col("p_partkey"), F.col("p_size")
    uuid = lambda c: F.concat(F.lit(_UUID), F.lpad(c.cast("string"), 12, "0"))
    spans = filled('<span class="SalaryLong">Salary: Rp {size} - Rp {size} / Month</span><span class="SalaryX">Rp {size} / Month</span><span class="SalaryZ">usd only</span>', **_values())
    pay = F.when(size % 5 == 0, '<span class="SalaryX">Salary undisclosed</span>').when(size % 5 == 1, "Great place").otherwise(spans)
    v = _values(uuid=uuid(k), other=uuid(k + 1), pay=pay)
    url = F.when(k % 3 == 0, filled("https://glints.com/id/opportunities/jobs/role-{size}/{uuid}", **v)).otherwise(filled("https://glints.com/id/opportunities/explore?k={k}", **v))
    body = F.when(k % 3 == 0, filled(_GLINTS_DETAIL, **v)).when(k % 3 == 1, filled(_GLINTS_LIST, **v)).otherwise("<p>nothing here</p>")
    return _parsed(t("part"), url, body)


_NEXT = '<html><body><script id="__NEXT_DATA__" type="application/json">{state}</script></body></html>'
_RP = "'Rp' || CASE WHEN {0} < 1000 THEN CAST({0} AS VARCHAR) ELSE replace(format('{{:,}}', {0}), ',', '.') END"
_LOW, _HIGH = "CAST(p_size AS BIGINT) * 1000000", "(CAST(p_size AS BIGINT) * 1000000 + 500000)"
_DEALLS_PAY = f"CASE WHEN p_partkey % 8 = 0 THEN 'Unpaid' ELSE {_RP.format(_LOW)} || ' – ' || {_RP.format(_HIGH)} END"


@query(f"""
SELECT p_partkey, CAST(0 AS BIGINT) AS pos, 'detail' AS kind, false AS failed, 'https://dealls.com/loker/job-' || p_partkey || '~co-' || p_size AS source_url, p_name AS title, p_brand AS company, {_DEALLS_PAY} AS salary,
    'Deskripsi Pekerjaan' || chr(10) || '• do ' || p_type || chr(10) || chr(10) || 'Kualifikasi' || chr(10) || 'be ' || p_size AS description FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 0, 'detail', false, 'https://dealls.com/loker/job-' || p_partkey || '~co-' || p_size, p_name, p_brand, 'Rp ' || p_size, 'Kualifikasi' || chr(10) || 'need ' || p_type FROM part WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, i, 'listing', false, 'https://dealls.com/loker/' || CASE i WHEN 0 THEN 'job-' ELSE 'more-' END || p_partkey || '~co-' || p_size, p_name, p_brand, {_DEALLS_PAY}, '' FROM part, range(2) r(i) WHERE p_partkey % 4 = 2
UNION ALL SELECT p_partkey, i, 'listing', false, 'https://dealls.com/loker/' || CASE i WHEN 0 THEN 'a-' ELSE 'b-' END || p_partkey || '~co', CASE i WHEN 0 THEN p_name ELSE 'plain ' || p_partkey END, '', 'Negotiable', '' FROM part, range(2) r(i) WHERE p_partkey % 4 = 3""")
def dealls_pages(t, spark, sf):
    """Details and listings, from the page's state and from its nodes."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    low = size * 1_000_000

    def job(slug: Column) -> Column:
        return F.struct(F.concat(F.lit("  "), "p_name").alias("role"), slug.alias("slug"), F.when(k % 8 == 0, "unpaid").otherwise("paid").alias("salaryType"),
                        F.struct(low.alias("start"), (low + 500_000).alias("end")).alias("salaryRange"), filled("<ul><li>do {type}</li></ul>", **_values()).alias("responsibilities"),
                        filled("<p>be {size}</p>", **_values()).alias("requirements"), F.struct(F.col("p_brand").alias("name"), filled("co-{size}", **_values()).alias("slug")).alias("company"))

    def state(key: str, data: Column) -> Column:
        query_ = F.struct(F.array(F.lit(key), F.lit("x")).alias("queryKey"), F.struct(data.alias("data")).alias("state"))
        return filled(_NEXT, state=F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(query_).alias("queries")).alias("dehydratedState")).alias("pageProps")).alias("props"))))

    own = filled("job-{k}", **_values())
    docs = F.array(job(own), job(own), job(F.lit("saved")), job(filled("more-{k}", **_values())))
    nodes = '<h1>{name}</h1><a href="/karir/x">{brand}</a><span>Rp {size}.000.000 sampai</span><span>Rp {size}</span><div><h3>Kualifikasi</h3><div><p>need {type}</p></div></div>'
    cards = '<div id="jobs-container"><a href="/loker/a-{k}~co"><h3>{name}</h3>noise</a><a href="/loker/saved~co">s</a><a href="/loker/b-{k}~co?x=1">plain {k}</a></div>'
    body = (F.when(k % 4 == 0, state("x/v1/job-portal/job/slug/a", job(own))).when(k % 4 == 1, filled(nodes, **_values()))
            .when(k % 4 == 2, state("/v1/explore-job/job", F.struct(F.array(F.struct(docs.alias("docs"))).alias("pages")))).otherwise(filled(cards, **_values())))
    url = F.when(k % 4 < 2, filled("https://dealls.com/loker/job-{k}~co-{size}", **_values())).otherwise(filled("https://dealls.com/?searchJob={k}", **_values()))
    return _parsed(t("part"), url, body)


@query(f"""
SELECT p_partkey, CAST(0 AS BIGINT) AS pos, 'detail' AS kind, false AS failed, 'https://www.kalibrr.id/id-ID/c/co-' || p_size || '/jobs/' || (p_partkey + 1) || '/s' AS source_url, p_name AS title, p_brand AS company,
    CASE WHEN p_partkey % 3 = 0 THEN 'Gaji Tidak Diumumkan' ELSE {_RP.format(_LOW)} || ' / bulan' END AS salary,
    'Deskripsi Pekerjaan' || chr(10) || 'd ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || 'Kualifikasi Minimum' || chr(10) || '• q' ELSE '' END AS description FROM part WHERE p_partkey % 5 <> 4
UNION ALL SELECT p_partkey, NULL, 'detail', true, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 4""")
def kalibrr_pages(t, spark, sf):
    """Details from the page's state in both spellings; pages without a job."""
    k, low = F.col("p_partkey"), F.col("p_size").cast("long") * 1_000_000
    html, quals, code = filled("<p>d {type}</p>", **_values()), F.when(k % 2 == 0, "<ul><li>q</ul>"), filled("co-{size}", **_values())
    company = F.struct(code.alias("code"), F.col("p_brand").alias("name"))
    camel = F.struct((k + 1).alias("id"), F.col("p_name").alias("name"), F.lit("s").alias("slug"), html.alias("description"), quals.alias("qualifications"), low.alias("baseSalary"), F.lit("Month").alias("salaryInterval"), (k % 3 != 0).alias("salaryShown"), F.col("p_brand").alias("companyName"), company.alias("companyInfo"))
    snake = F.struct((k + 1).alias("id"), F.col("p_name").alias("name"), F.lit("s").alias("slug"), html.alias("description"), quals.alias("qualifications"), (low.cast("double") + 0.5).alias("base_salary"), F.lit("monthly").alias("salary_interval"), (k % 3 != 0).alias("salary_shown"), company.alias("company"))
    state = lambda job: F.to_json(F.struct(F.struct(F.struct(job.alias("job")).alias("pageProps")).alias("props")))
    body = filled(_NEXT, state=F.when(k % 5 == 4, F.lit('{"props": {"pageProps": {}}}')).when(k % 2 == 0, state(camel)).otherwise(state(snake)))
    return _parsed(t("part"), filled("https://www.kalibrr.id/c/co-{size}/jobs/{k}/s?x=1", **_values()), body)


_POST = '<meta property="og:description" content="Now hiring | Tram Driver {k}&#10;Join Nation{size} Lantern Pte Ltd">{og}<script>{open}"plaintext":"{long}"{close} {open}"plaintext":"some other post that is longer than all the rest of this page together, by far, so that only its start tells"{close}</script>'


@query("""
SELECT p_partkey, CAST(0 AS BIGINT) AS pos, 'detail' AS kind, false AS failed, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.threads.com/@other/post/Q' || p_partkey ELSE 'https://www.threads.com/@depot/post/P' || p_partkey END AS source_url,
    'Tram Driver ' || p_partkey AS title, 'Nation' || p_size || ' Lantern Pte Ltd' AS company, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Pay: SGD ' || p_size || '/hour' END AS salary,
    'Now hiring | Tram Driver ' || p_partkey || chr(10) || 'Join Nation' || p_size || ' Lantern Pte Ltd' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' in town. Pay: SGD ' || p_size || '/hour' END AS description FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT p_partkey, NULL, 'detail', true, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 7 = 0""")
def social_posts(t, spark, sf):
    """Posts whose whole caption stands in the page, posts with the short one only, posts without any."""
    k = F.col("p_partkey")
    caption = filled(r"Now hiring | Tram Driver {k}\nJoin Nation{size} Lantern Pte Ltd", **_values())
    long = F.when(k % 3 == 0, "not the same").otherwise(F.concat(caption, filled(" in town. Pay: SGD {size}/hour", **_values())))
    og = F.when(k % 2 == 0, filled('<meta property="og:url" content="https://www.threads.net/@other/post/Q{k}/">', **_values()))
    body = F.when(k % 7 != 0, filled(_POST, **_values(long=long, og=og, open=F.lit("{"), close=F.lit("}")))).otherwise("<p>log in</p>")
    return _parsed(t("part"), filled("https://www.threads.net/@depot/post/P{k}?x=1", **_values()), body)
