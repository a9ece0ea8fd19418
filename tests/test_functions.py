from pyspark.sql import functions as F

from adloom.functions import captions, prompts, salary, text, urls


def test_white_space_and_lines(col):
    assert col(text.collapse_ws, ["  a   b\t\nc ", "", None], "a string") == ["a b c", "", None]
    assert col(text.cleanup_text, ["\r\n a  b\r\r\n\n\n c d \n \n", "x"], "a string") == ["a b\n\nc d", "x"]
    assert col(lambda c: text.caption_lines(c, 2), ["\r\n a \n\n b\nc"], "a string") == [["a", "b"]]
    assert col(lambda c: text.cut_bytes(c, 4), ["abcd", "abcde", "abcé", None], "a string") == ["abcd", "abcd", "abc", None]


def test_extract_urls(col):
    got = col(text.extract_urls, ["a http://x.y/1, b https://z/2). http://x.y/1", "none", None], "a string")
    assert got == [["http://x.y/1", "https://z/2"], [], []]


def test_route(col):
    cases = {"https://www.threads.com/@a/post/1": "threads", "https://threads.net/x": "threads", "https://id.jobstreet.com/job/1": "jobstreet", "https://www.kalibrr.id/c": "kalibrr",
             "https://GLINTS.com/id": "glints", "https://dealls.com/": "dealls", "https://example.com": "static", "https://threadless.com": "static", "bad": "static", None: "static"}
    assert col(urls.route, list(cases), "a string") == list(cases.values())


def test_detail_urls(col):
    u = "/opportunities/jobs/harbour-pilot/0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"
    cases = {
        "jobstreet": {"https://id.jobstreet.com/job/41?x#y": True, "https://id.jobstreet.com/id/job/41/": True, "https://id.jobstreet.com/jobs/41": False, "https://id.jobstreet.com/id/job/a": False},
        "glints": {f"https://glints.com/id{u}": True, f"https://glints.com/id/en{u}": True, f"https://glints.com{u.replace('harbour-pilot', 'explore')}": False, "https://glints.com/id/opportunities/jobs/x": False},
        "dealls": {"https://dealls.com/loker/a~b": True, "https://dealls.com/loker/saved~b": False, "https://dealls.com/loker/a": False},
        "kalibrr": {"https://www.kalibrr.id/id-ID/c/x/jobs/1/y": True, "https://www.kalibrr.id/c/x/jobs/1/y/": True, "https://www.kalibrr.id/c/x/jobs/y": False},
    }
    for board, urls_ in cases.items():
        assert col(lambda c, b=board: urls.is_detail_url(b, c), list(urls_), "a string") == list(urls_.values()), board


def test_canonical_and_resolve(col):
    assert col(urls.canonical_url, ["https://k.id/ads/8/?from=mail#part", "http://a.com/", "http://", "/x//"], "a string") == ["https://k.id/ads/8", "http://a.com", "http://", "/x"]
    got = col(urls.canonical_threads_url, [("https://www.threads.net/@kiosk/post/Bq3?from=feed#top", "http://threads.net/@Depot/post/Kk7/"), ("https://www.threads.net/@A/post/1?x", None), ("https://a.b/c?d", "")], "a string, b string")
    assert got == ["https://www.threads.com/@Depot/post/Kk7", "https://www.threads.com/@A/post/1", "https://a.b/c"]
    base = "https://a.b/c/d?e#f"
    assert col(lambda h: urls.resolve_url(F.lit(base), h), ["http://x/y", "//h/p", "/r", "s", "?q", "#z"], "a string") == ["http://x/y", "https://h/p", "https://a.b/r", "https://a.b/c/s", "https://a.b/c/d?q", "https://a.b/c/d?e#z"]


def test_search_terms_and_api_urls(col):
    assert col(urls.kalibrr_search, ["https://www.kalibrr.id/id-ID/home/te/tram%20driver", "https://www.kalibrr.id/c/x/jobs/1/y"], "a string") == ["tram driver", ""]
    assert col(urls.dealls_search, ["https://dealls.com/?a=1&searchJob=night+nurse&b", "https://dealls.com/"], "a string") == ["night nurse", ""]
    assert col(lambda s: urls.kalibrr_api_url(s, F.lit(30)), ["welder"], "a string")[0].endswith("/kjs/job_board/search?limit=15&offset=30&text=welder")
    assert col(urls.dealls_href, [("a", " b "), ("", "b"), (None, "b")], "a string, b string") == ["/loker/a~b", "", ""]
    assert col(urls.kalibrr_href, [("c", 7, "s"), ("c", 0, "s"), (None, 7, "s")], "a string, b long, c string") == ["/id-ID/c/c/jobs/7/s", "", ""]


def test_salary_text(col):
    cases = {"Upah sebulan Rp. 4.100.000 - Rp. 6.200.000 ya": "Rp. 4.100.000 - Rp. 6.200.000", "from MYR 1,800–2,900/year on": "MYR 1,800–2,900/year", "upah menarik": "", "Corp., Ltd": "rp.,", "Please pay, then": "pay,"}
    got = col(salary.find_salary, list(cases), "a string")
    assert [g.strip().lower() for g in got] == [v.lower() for v in cases.values()]
    assert col(lambda c: salary.find_salary(c, strict=True), ["Please pay, then USD 5k"], "a string") == ["USD 5k"]
    assert col(salary.looks_like_salary, ["Gaji", "negotiable", "hello", "$ 5"], "a string") == [True, True, False, True]
    assert col(salary.looks_like_glints_salary, ["Rp 5", "rp 5", "Undisclosed", "$"], "a string") == [True, False, True, False]


def test_board_salaries(col):
    schema = "a string, b long, c long"
    rows = [("unpaid", None, None), ("paid", None, None), ("paid", 3200000, 4100000), ("paid", 8800000, 8800000), ("paid", 0, 5)]
    assert col(salary.dealls_salary, rows, schema) == ["Unpaid", "Negotiable", "Rp3.200.000 – Rp4.100.000", "Rp8.800.000", "Rp5"]
    rows = [(False, 5, 6, "month"), (True, 2500000, 2600000, "Week"), (None, 9900000, 9900000, "hourly"), (True, None, None, "x"), (None, 5, 0, "x")]
    assert col(salary.kalibrr_salary, rows, "a boolean, b long, c long, d string") == ["Gaji Tidak Diumumkan", "Rp2.500.000 – Rp2.600.000 / minggu", "Rp9.900.000 / jam", "Gaji Tidak Diumumkan", "Rp5"]
    assert col(salary.default_salary, [("glints", ""), ("dealls", None), ("static", ""), ("dealls", "x")], "a string, b string") == ["Salary Undisclosed", "Negotiable", "", "x"]
    assert col(salary.format_idr, [-1234567, 0], "a long") == ["Rp1.234.567", "Rp0"]


def test_captions(col):
    cases = [  # caption, title, company, salary
        ("Hello all!\nNow hiring: Tram Driver\nUpah: UMK", "Tram Driver", "", "Upah: UMK"),
        ("we are hiring - Museum Guide 💰 good pay, 📞 later", "Museum Guide", "", "pay,"),
        ("Lowongan kerja | ★ Bridge Painter", "Bridge Painter", "", ""),
        ("WE'RE HIRING | ZÜRCHER WERKE\nMYR 900 per hour", "", "ZÜRCHER WERKE", "MYR 900 per hour"),
        ("Hiring: Harbour Pilot\nAt Kopi Lentera Pte. Ltd. you sail", "Harbour Pilot", "Kopi Lentera Pte. Ltd", ""),
        ("news of P.T. Samudera Raya; and more", "", "P.T. Samudera Raya", ""),
        ("join the Blue Door Limited", "", "Blue Door Limited", ""),
        ("rehiring - Nobody", "", "", ""), ("", "", "", ""), (None, "", "", ""),
    ]
    got = col(captions.caption_fields, [c[0] for c in cases], "a string")
    assert [(g.title, g.company, g.salary) for g in got] == [c[1:] for c in cases]
    assert col(captions.looks_like_org, ["BLUE DOOR", "Plant Operator", "Small kiosk", "pt laut biru", ""], "a string") == [True, False, False, True, False]


def test_best_caption(col):
    got = col(captions.best_caption, [("Hello big", ["Hello big world", "Other much longer text here", "Hello  big"]), ("", ["x"]), ("a", [])], "a string, b array<string>")
    assert got == ["Hello big world", "", "a"]


def test_prompts(col):
    p = {"full_name": " Ann ", "skills": "", "signature": "S", "zeta": "z ", "alpha": "a"}
    got = col(prompts.cover_letter_prompt, [(p, "T", None, "D")], "p map<string,string>, a string, b string, c string")[0]
    assert got == "Candidate profile:\n- full_name: Ann\n- alpha: a\n- zeta: z \n\nJob:\nTitle: T\nCompany: \nDescription:\nD\n\nWrite a tailored cover letter."
    paste = col(prompts.paste_prompt, [(p, " ")], "p map<string,string>, a string")[0]
    assert paste.startswith(prompts.LETTER_SYSTEM + "\n\nCandidate") and paste.endswith("\nJob Ad:\n\n\nWrite a tailored cover letter.")
    assert col(prompts.with_signature, [("x", " s "), ("x", None)], "a string, b string") == ["x\n\ns", "x"]
    assert col(prompts.missing_fields, [("t", " ", None)], "a string, b string, c string") == [["company", "salary"]]
    answers = ['```json\n{"title": " T ", "company": "C"}\n```', 'Sure: {"title":"x","salary":null} ok', "no", '{"title": 5}']
    got = col(prompts.decode_fields, answers, "a string")
    assert [tuple(g) if g else None for g in got] == [("T", "C", ""), ("x", "", ""), None, None]


def test_times(col):
    got = col(lambda c: text.format_ts(text.parse_ts(c)), ["2024-02-29 23:59:01", "2023-02-29 00:00:00", "2024-02-29", "x", "", None], "a string")
    assert got == ["2024-02-29 23:59:01", None, None, None, None, None]
