"""The one helper for HTML: it selects nodes of a page, and reads text with line breaks. All rules are elsewhere, as Columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that stand on lines of their own.
BLOCK = (
    "address", "article", "aside", "blockquote", "div", "dl", "dt", "dd", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul",
)
#: A start tag that closes an open one of the second set (in the same parent chain, up to the third).
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What starts an item that has a bullet already.
BULLETS = "•·‣▪○-*–—"
#: Elements below this depth become siblings, as in browsers, so that no tag has to look through more.
DEEPEST = 512
#: Pages whose facts are handed on together.
PAGES = 250


#: A tag, comment or doctype whose spelling leaves nothing to guess; attributes are told apart by _ATTR when they are asked for.
_TOKEN = re.compile(
    r"<(?:/(?P<end>[a-zA-Z][-.a-zA-Z0-9:_]*)\s*>|(?P<tag>[a-zA-Z][-a-zA-Z0-9:_]*)(?P<attrs>(?:\s+[^\s/>\"'=<]+(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"|[^\s\"'=<>`]+))?)*)\s*(?P<alone>/?)>|!--(?:(?!--\s*>).)*-->|![dD][oO][cC][tT][yY][pP][eE][^>\[]*>)",
    re.DOTALL)
_ATTR = re.compile(r"\s+([^\s/>\"'=<]+)(?:\s*=\s*('[^']*'|\"[^\"]*\"|[^\s\"'=<>`]+))?")
_RAW = {tag: re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}


class Node:
    __slots__ = ("_attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | str, parent: Node | None) -> None:
        self.tag, self._attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def attrs(self) -> dict[str, str]:
        """By name; of a repeated one the first counts."""
        if isinstance(self._attrs, str):
            found = {}
            for name, value in _ATTR.findall(self._attrs):
                found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
            self._attrs = found
        return self._attrs

    def has(self, name: str) -> bool:
        """Is there such an attribute; attributes are told apart only where the name stands among them."""
        return (not isinstance(self._attrs, str) or name in self._attrs.lower()) and name in self.attrs

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def first_mark(self) -> str:
        """The first character that is not white space, or ''."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if not isinstance(c, str):
                stack += reversed(c.children)
            elif s := c.lstrip():
                return s[0]
        return ""

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")


class _Builder(HTMLParser):
    """A tree that forgives what is not closed: end tags without a start are dropped, a `<p>` ends at the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]] | str) -> None:
        ends, stop = CLOSES.get(tag, (set(), set()))
        if tag in BLOCK:
            ends, stop = ends | {"p"}, stop | {"button", "object"}
        n, up = self.at, 1
        while ends and n.parent is not None and n.tag not in stop:
            if n.tag in ends:
                self.at, self.depth = n.parent, self.depth - up
                break
            n, up = n.parent, up + 1
        node = Node(tag, attrs if isinstance(attrs, str) else {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < DEEPEST:
            self.at, self.depth = node, self.depth + 1

    def handle_endtag(self, tag: str) -> None:
        n, up = self.at, 1
        while n.parent is not None and n.tag != tag:
            n, up = n.parent, up + 1
        if n.parent is not None:
            self.at, self.depth = n.parent, self.depth - up

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _plainly(html: str) -> Node | None:
    """The tree of a page that is spelled without doubt, token by token; None for any other."""
    b, at = _Builder(), 0
    while (start := html.find("<", at)) >= 0:
        token = _TOKEN.match(html, start)
        if token is None:
            return None
        if start > at:
            b.handle_data(unescape(html[at:start]))
        at = token.end()
        if end := token["end"]:
            b.handle_endtag(end.lower())
        elif tag := token["tag"]:
            tag = tag.lower()
            b.handle_starttag(tag, token["attrs"])
            if token["alone"]:
                b.handle_endtag(tag)
            elif tag in _RAW:
                close = _RAW[tag].search(html, at)
                if close is None:
                    return None
                if close.start() > at:
                    b.handle_data(html[at:close.start()])
                at = close.start()
    if at < len(html):
        b.handle_data(unescape(html[at:]))
    return b.root


def parse(html: str) -> Node:
    """The tree of a page: plainly if its spelling allows, else by the forgiving reader; both give the same."""
    root = _plainly(html)
    if root is None:
        b = _Builder()
        b.feed(html)
        b.close()
        root = b.root
    return root


def with_breaks(node: Node) -> str:
    """Text with a line for each block, `<br>` and list item; items get `• ` unless they start with a bullet. Not yet cleaned up."""
    out: list[str] = []
    line = ""  # what the open line holds so far

    def put(s: str) -> None:
        nonlocal line
        out.append(s)
        line = (line + s).rpartition("\n")[2]

    def newline() -> None:
        if out and line:
            put("\n")

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        n, closing = stack.pop()
        if closing:
            newline()
        elif isinstance(n, str):
            if n and not (line == "• " and not n.strip()):
                put(n)
        elif n.tag == "br":
            put("\n")
        elif n.tag not in ("script", "style", "noscript"):
            block = n.tag in BLOCK
            if n.tag == "li":
                newline()
                mark = n.first_mark()
                if not mark or mark not in BULLETS:
                    put("• ")
            elif block and line != "• ":
                newline()
            if block or n.tag == "li":
                stack.append((n, True))
            stack += [(c, False) for c in reversed(n.children)]
    return "".join(out)


FACTS = (
    "title string, h1 string, h2 string, metas array<struct<name: string, property: string, content: string>>, "
    "links array<struct<href: string, url: string, text: string, rel: string, hidden: string>>, "
    "bodies array<struct<selector: string, text: string>>, salary_nodes array<string>, next_data string, "
    "automation map<string, string>, automation_html string, gtm_company string, glints_salaries array<string>, glints_overviews array<string>, glints_html string, "
    "seek_cards array<struct<hrefs: array<struct<href: string, url: string, own: boolean>>, title: string, anchor: string, company: string, salary: string>>, "
    "glints_cards array<struct<hrefs: array<struct<href: string, url: string>>, title: string, anchor: string, company: string, salaries: array<string>, overviews: array<string>>>, "
    "dealls_cards array<struct<href: string, url: string, title: string, text: string>>, dealls_company string, "
    "dealls_sections array<struct<label: string, html: string>>, leaves array<string>, plaintexts array<string>, error string"
)
def _top_level(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[start:i].strip())
            start = i + 1
    return [*parts, schema[start:].strip()]


_NAMES = [x.split(" ")[0].split(":")[0] for x in _top_level(FACTS)]
#: Fixed values, in this order: where a page may name a salary.
SALARY_SELECTORS = (
    lambda n: n.get("itemprop") == "baseSalary", lambda n: n.get("itemprop") == "salary", lambda n: "salary" in n.get("class"), lambda n: "Salary" in n.get("class"),
    lambda n: "salary" in n.get("id"), lambda n: "Salary" in n.get("id"), lambda n: "salary" in n.get("data-automation"),
    lambda n: "job-salary" in n.get("class").split(), lambda n: n.get("id") == "job-salary",
)
BODY_SELECTORS = {
    "article": lambda n: n.tag == "article", "main": lambda n: n.tag == "main", "role": lambda n: n.get("role") == "main",
    ".job-description": lambda n: "job-description" in n.get("class").split(), "#job-description": lambda n: n.get("id") == "job-description", "body": lambda n: n.tag == "body",
}


def _squeeze(s: str) -> str:
    return " ".join(s.split())


#: The facts that pages of an adapter are read for; of other pages all are.
FACTS_OF = {
    "static": ("title", "h1", "metas", "bodies", "salary_nodes"),
    "jobstreet": ("automation", "automation_html", "seek_cards"),
    "glints": ("h1", "gtm_company", "glints_salaries", "glints_overviews", "glints_html", "glints_cards"),
    "dealls": ("h1", "h2", "next_data", "dealls_cards", "dealls_company", "dealls_sections", "leaves"),
    "kalibrr": ("next_data",),
    "threads": ("metas", "plaintexts"),
}


class Page:
    """A page's nodes, sorted out by what selectors ask for in one walk; each method reads one fact."""

    def __init__(self, html: str, base: str) -> None:
        self.html, self.base, self.root = html, base, parse(html)
        self.nodes = list(self.root.walk())
        self.tags: dict[str, list[Node]] = {}
        self.names: dict[tuple[str, ...], list[Node]] = {}
        for n in self.nodes:
            self.tags.setdefault(n.tag, []).append(n)

    def url(self, href: str) -> str | None:
        try:
            return urljoin(self.base, href)
        except ValueError:
            return None

    def tag(self, *names: str) -> list[Node]:
        return self.tags.get(names[0], []) if len(names) == 1 else [n for n in self.nodes if n.tag in names]

    def having(self, *names: str) -> list[Node]:
        """Nodes with one of these attributes, in order."""
        if names not in self.names:
            self.names[names] = [n for n in self.nodes if n._attrs and any(map(n.has, names))]
        return self.names[names]

    def by_class(self, part: str) -> list[Node]:
        return [n for n in self.having("class") if part in n.get("class")]

    def title(self):
        return _text(_first(self.tag("title")))

    def h1(self):
        return _text(_first(self.tag("h1")))

    def h2(self):
        return _text(_first(self.tag("h2")))

    def metas(self):
        return [{"name": n.get("name"), "property": n.get("property"), "content": n.attrs["content"]} for n in self.tag("meta") if "content" in n.attrs]

    def links(self):
        return [{"href": h, "url": self.url(h), "text": _text(n), "rel": n.get("rel"), "hidden": n.get("aria-hidden").strip().lower()}
                for n in self.tag("a") if "href" in n.attrs for h in (n.get("href").strip(),)]

    def bodies(self):
        found = []
        for name, test in BODY_SELECTORS.items():
            known = {"article": ("article",), "main": ("main",), "body": ("body",)}.get(name)
            found.append((name, _first(self.tag(*known) if known else self.having("role", "class", "id"), test)))
        out = [{"selector": name, "text": _text(n)} for name, n in found if n is not None]
        return out if out and out[-1]["selector"] == "body" else [*out, {"selector": "body", "text": _text(self.root)}]

    def salary_nodes(self):
        return [_text(n) or _squeeze(n.get("content")) for n in _firsts(SALARY_SELECTORS, self.having("itemprop", "class", "id", "data-automation")) if n is not None]

    def next_data(self):
        data = _first(self.tag("script"), lambda n: n.get("id") == "__NEXT_DATA__")
        return data.text().strip() if data is not None else None

    def automation(self):
        return {k: _text(_first(self.having("data-automation"), lambda n, k=k: n.get("data-automation") == k)) for k in ("job-detail-title", "advertiser-name", "job-detail-salary")}

    def automation_html(self):
        details = _first(self.having("data-automation"), lambda n: n.get("data-automation") == "jobAdDetails")
        return with_breaks(details) if details is not None else ""

    def gtm_company(self):
        return _company(self.having("data-gtm-company-name"))

    def glints_salaries(self):
        return [_text(n) for n in self.by_class("Salary")]

    def glints_overviews(self):
        return [_text(n) for n in self.by_class("JobOverview")]

    def glints_html(self):
        box = _first(self.by_class("JobDescriptionsc__DescriptionContainer"))
        return with_breaks(box) if box is not None else ""

    def seek_cards(self):
        out = []
        for card in (n for n in self.having("data-automation") if n.get("data-automation") == "normalJob"):
            inner = list(card.walk())
            links = [n for n in inner if n.tag == "a"]
            said = {k: _text(_first(inner, lambda n, k=k: n.get("data-automation") == k)) for k in ("jobTitle", "jobCompany", "jobSalary")}
            hrefs = [{"href": h, "url": self.url(h), "own": n.get("data-automation") == "job-list-view-job-link"} for n in links if "href" in n.attrs for h in (n.get("href").strip(),)]
            out.append({"hrefs": hrefs, "title": said["jobTitle"], "anchor": _text(_first(links)), "company": said["jobCompany"], "salary": said["jobSalary"]})
        return out

    def glints_cards(self):
        out = []
        for card in self.having("data-gtm-job-id"):
            inner = list(card.walk())
            links, classed = [n for n in inner if n.tag == "a"], [n for n in inner if "class" in n.attrs]
            texts = lambda part: [_text(n) for n in classed if part in n.get("class")]  # noqa: E731, B023
            company = _company([card, *inner]) or _text(_first(inner, lambda n: n.get("data-cy") == "company_name_job_card"))
            hrefs = [{"href": h, "url": self.url(h)} for n in links if "href" in n.attrs for h in (n.get("href").strip(),)]
            out.append({"hrefs": hrefs, "title": _text(_first(classed, lambda n: "JobTitle" in n.get("class"))), "anchor": _text(_first(links)), "company": company,
                        "salaries": texts("Salary"), "overviews": texts("JobOverview")})
        return out

    def dealls_cards(self):
        out = []
        for box in (n for n in self.having("id") if n.get("id") == "jobs-container"):
            for a in (n for n in box.walk() if n.tag == "a" and "/loker/" in n.get("href")):
                named = _first(list(a.walk()), lambda n: n.tag in ("h2", "h3") or "JobTitle" in n.get("class") or "job-title" in n.get("class"))
                href = a.get("href").strip()
                out.append({"href": href, "url": self.url(href), "title": _text(named), "text": _text(a)})
        return out

    def dealls_company(self):
        return next((t for n in self.tag("a") if "/karir/" in n.get("href") and (t := _text(n))), "")

    def dealls_sections(self):
        out = []
        for h in self.tag("h3"):
            siblings = h.parent.elements()
            after = siblings[siblings.index(h) + 1:][:1] or [n for n in siblings if n.tag != "h3"][:1]
            if after and after[0].children:
                inside = Node("div", {}, None)
                inside.children = after[0].children
                out.append({"label": _text(h), "html": with_breaks(inside)})
        return out

    def leaves(self):
        return [_text(n) for n in self.tag("span", "li", "p", "div") if not n.elements()]

    def plaintexts(self):
        from adloom.sources.payload import plaintexts

        return plaintexts(self.html)


def _text(n: Node | None) -> str:
    return _squeeze(n.text()) if n is not None else ""


def _first(among: list[Node], test=None) -> Node | None:
    return next((n for n in among if test is None or test(n)), None)


def _firsts(tests, among: list[Node]) -> list[Node | None]:
    """The first node of each test, in one walk."""
    tests = list(tests)
    out, left = [None] * len(tests), set(range(len(tests)))
    for n in among:
        for k in [k for k in left if tests[k](n)]:
            out[k] = n
            left.discard(k)
        if not left:
            break
    return out


def _company(among: list[Node]) -> str:
    return next((v for n in among if (v := _squeeze(n.get("data-gtm-company-name")))), "")


def facts(html: str | None, base: str | None, adapter: str | None = None, also: str | None = None) -> dict:
    """The nodes that adapters read, of one page; texts of descriptions come with breaks. With an adapter only what its rules read (and those of `also`), and links always."""
    page = Page(html or "", base or "")
    wanted = FACTS_OF.get(adapter, _NAMES[:-1]) if adapter else _NAMES[:-1]
    return {n: getattr(page, n)() for n in {"links", *wanted, *(FACTS_OF[also] if also else ())}}


def page_facts(pages: DataFrame, body: str = "body", base: str = "final_url", adapter: str | None = None, also: str | None = None) -> DataFrame:
    """pages with a struct `facts` for their body, which is dropped; a page that can't be read has facts.error.

    adapter names a column: pages are then read for the facts of their adapter only (and those of the adapter `also`).
    """
    @F.pandas_udf(FACTS)
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, bases, adapters in parts:
            for at in range(0, len(bodies), PAGES):  # facts take more room than pages
                rows = []
                for b, u, a in zip(*(x.iloc[at:at + PAGES] for x in (bodies, bases, adapters)), strict=True):
                    try:
                        row = facts(b, u, a, also) | {"error": None}
                    except Exception as e:  # a page must not end the job
                        row = {"error": f"{type(e).__name__}: {e}"}
                    rows.append({n: row.get(n) for n in _NAMES})
                yield pd.DataFrame(rows, columns=_NAMES)

    keep = [c for c in pages.columns if c != body]
    chosen = F.lit(None).cast("string") if adapter is None else F.col(adapter)
    # so marked, the optimizer neither repeats the helper nor moves it into other expressions
    return pages.select(*keep, read.asNondeterministic()(F.col(body), F.col(base), chosen).alias("facts"))


def text_with_breaks(c):
    """H2 as a Column: an HTML fragment's text with breaks, cleaned up."""
    from adloom.functions.text import cleanup_text

    @F.pandas_udf("string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: with_breaks(parse(f"<div>{x}</div>")) if isinstance(x, str) and x.strip() else "")

    return cleanup_text(read.asNondeterministic()(c))
