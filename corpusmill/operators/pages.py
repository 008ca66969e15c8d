"""Elements of web pages: one Arrow pass with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import explode_rows, map_rows
from corpusmill.session import ship, spread

#: Containers whose text is an element, by kind.
BOXES = {"title": "title", "nav": "nav", "footer": "nav", "menu": "nav", "code": "code", "pre": "code", "details": "summary", "address": "address", "form": "form", "table": "table", "figcaption": "figcaption"}
BLOCKS = frozenset("p div li tr td th br hr h1 h2 h3 h4 h5 h6 section article aside main header ul ol option".split())
HIDDEN, VOID = frozenset(("script", "style", "template", "noscript")), frozenset(("img", "meta", "input", "br", "hr", "source", "link", "area", "base", "col", "embed", "wbr"))
RIGHTS = ("copyright", "privacy", "terms", "license", "licence", "legal", "imprint")
#: Blocks that end a sentence.
SENTENCE_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p div hr pre article main section aside".split())
#: Signs that stand for the border of a cell and the end of a block while a page is read.
CELL, END = "\x1f", "\x1e"
LEAST_IMAGE, MOST_LINK, LEAST_INPUTS = 75, 100, 3


def _tidy(parts: list[str], joint: str) -> str:
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return joint.join(line for line in lines if line)


def _table(parts: list[str], header: bool) -> str:
    """Rows of cells joined by " | ", with --- behind a header row; empty unless there are more than three rows, or without a
    header more than one, and the first has several cells."""
    rows = [" | ".join(" ".join(c.split()) for c in line.split(CELL) if c.strip()) for line in "".join(parts).split("\n")]
    rows = [r for r in rows if r]
    if not rows or " | " not in rows[0] or not (len(rows) > 3 or (len(rows) > 1 and not header)):
        return ""
    return "\n".join([rows[0], "---", *rows[1:]] if header else rows)


def _size(value: str | None) -> int | None:
    digits = "".join(c for c in value or "" if c.isdigit())
    return int(digits) if digits else None


class Elements(HTMLParser):
    """Collects (kind, value) in page order of their ends; the innermost box owns its text."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.open, self.hidden = base, [], [], 0
        self.page: list[str] = []
        self.counts: dict[str, int] = {}

    def record(self, kind: str, value: str) -> None:
        """Keeps an element; its mark stands in the page's text unless another element holds it."""
        n = self.counts.get(kind, 0)
        self.counts[kind] = n + 1
        self.found.append((kind, n, value))
        if not self.open and kind not in ("title", "meta"):
            self.page.append(f" ###{kind}###{n}### ")

    def address(self, link: str | None) -> str:
        try:
            return urljoin(self.base, link or "")
        except ValueError:
            return link or ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "meta" and a.get("name") and a.get("content"):
            self.record("meta", f"{a['name']}: {a['content']}")
        elif tag == "img":
            sizes = [s for s in (_size(a.get("width")), _size(a.get("height"))) if s is not None]
            if a.get("src") and all(s > LEAST_IMAGE for s in sizes):
                alt = a.get("alt") or ""
                self.record("img", self.address(a["src"]) + (f" [{alt}]" if alt and "." not in alt else ""))
        elif tag == "area":
            if a.get("alt") and a.get("href"):
                self.record("area", f"{a['alt']}:{self.address(a['href'])}")
        elif tag in ("iframe", "video", "audio"):
            if a.get("src"):
                self.record(tag, self.address(a["src"]))
            elif tag != "iframe":
                self.open.append([tag, tag, [], None, []])
        elif tag == "source" and self.open and self.open[-1][1] in ("video", "audio") and a.get("src"):
            self.open[-1][3] = self.open[-1][3] or self.address(a["src"])
        elif tag == "a" and a.get("href"):
            self.open.append(["a", "rights_link", [], self.address(a["href"]), []])
        elif tag == "input":
            for box in self.open[::-1]:
                if box[0] == "form" and a.get("name"):
                    value = a.get("value") or ""
                    box[4].append(a["name"] + ("" if a.get("type") == "hidden" or len(value) > 10 else f":{value}"))
                    break
        elif tag in BOXES:
            self.open.append([tag, BOXES[tag], [], None, []])
        if tag in BLOCKS and self.open:
            table = self.open[-1][0] == "table"
            self.open[-1][2].append(CELL if table and tag in ("td", "th") else "\n")
            if table and tag == "th":
                self.open[-1][4].append("th")
        elif tag in BLOCKS:
            self.page.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif any(box[0] == tag for box in self.open):
            while self.close_last() != tag:
                pass
        if tag in SENTENCE_BLOCKS and not self.open and not self.hidden:
            self.page.append(END)

    def close_last(self) -> str:
        tag, kind, parts, link, inputs = self.open.pop()
        text = _table(parts, bool(inputs)) if kind == "table" else _tidy(parts, " | " if kind in ("nav", "form", "address") else "\n")
        if kind == "rights_link":
            (self.open[-1][2] if self.open else self.page).append(text)
            if len(text) < MOST_LINK and any(w in text.lower() for w in RIGHTS):
                self.record(kind, f"{text}:{link}")
        elif kind in ("video", "audio"):
            if link:
                self.record(kind, link)
        elif text:
            self.record(kind, text)
        if kind == "form" and len(inputs) >= LEAST_INPUTS:
            self.record("inputs", "; ".join(inputs))
        return tag

    def handle_data(self, data):
        if not self.hidden:
            (self.open[-1][2] if self.open else self.page).append(data)


def _read(html: str | None, url: str | None) -> Elements:
    parser = Elements(url or "")
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.close_last()
    return parser


def elements(html: str | None, url: str | None) -> list[tuple[str, int, str]]:
    """(kind, number of its kind, value); a box left open ends with the page."""
    return _read(html, url).found


_SPACED_END = re.compile(rf"\s*{END}\s*")


def page_text(html: str | None, url: str | None) -> tuple[str | None, str, str, list[tuple[str, int, str]]]:
    """(title, meta joined by "; ", text, elements): in the text, marks ###kind###n### stand for elements.

    Headings and other blocks end a sentence: a full stop is set where none is. The first place that
    holds the title gets its mark, else it stands first.
    """
    parser = _read(html, url)
    parts = [" ".join(p.split()) for p in _SPACED_END.split("".join(parser.page))]
    text = " ".join(p if p[-1] in ".!?:…。！？" or p.endswith("###") else f"{p}." for p in parts if p)
    title = next((value for kind, _, value in parser.found if kind == "title"), None)
    if title:
        mark = "###title###0###"
        text = text.replace(title, mark, 1) if title in text else f"{mark} {text}".strip()
    meta = "; ".join(value for kind, _, value in parser.found if kind == "meta")
    return title, meta, text, parser.found


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, title, meta, text, elements (array of kind, n, val), reason: "no element" or "no text" rejects a page, else null."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("val", T.StringType())]))
    fields = [("title", T.StringType()), ("meta", T.StringType()), ("text", T.StringType()), ("elements", kind), ("reason", T.StringType())]

    def run(url, html):
        title, meta, text, found = page_text(html, url)
        plain = _MARK.sub("", text).strip()
        reason = "no element" if not found else "no text" if not plain else None
        return title, meta, text, [dict(zip(("kind", "n", "val"), e, strict=True)) for e in found], reason

    return map_rows(pages, ["url", "html"], fields, lambda: run, keep=["page_id"])


_MARK = re.compile(r"###\w+###\d+###")


def positions(records: DataFrame) -> DataFrame:
    """page_id, element_id, kind, val, position, rel_position: where an element's mark stands in its page's text (from 0), and its share.

    Elements whose mark is not in the text (inside another element) have no row.
    """
    rows = records.select("page_id", "text", F.explode("elements").alias("e"))
    mark = F.concat(F.lit("###"), F.col("e.kind"), F.lit("###"), F.col("e.n"), F.lit("###"))
    rows = rows.select("page_id", mark.alias("element_id"), "e.kind", "e.val", "text").withColumn("position", F.instr("text", F.col("element_id")) - 1).filter("position >= 0")
    return rows.select("page_id", "element_id", "kind", "val", "position", F.round(F.col("position") / F.length("text"), 6).alias("rel_position"))


def page_elements(pages: DataFrame) -> DataFrame:
    """page_id, kind, n, val: one row an element. Pages without any have no row."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            ids, urls, htmls = (c.to_pylist() for c in batch.columns)
            rows = [(i, *e) for i, u, h in zip(ids, urls, htmls, strict=True) for e in elements(h, u)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "kind", "n", "val"])

    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, kind string, n int, val string")


class Links(HTMLParser):
    """Collects the addresses of links as they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [value for name, value in attrs if name == "href" and value is not None]


def links(pages: DataFrame) -> DataFrame:
    """page_id, n, link: absolute addresses in page order; what can't be joined to the page's stays as it is."""
    def join(base, link):
        try:
            return urljoin(base, link)
        except ValueError:
            return link

    def run(url, html):
        parser = Links()
        parser.feed(html or "")
        parser.close()
        return [(i, join(url or "", link)) for i, link in enumerate(parser.found)]

    return explode_rows(pages, "page_id", ["url", "html"], [("n", T.IntegerType()), ("link", T.StringType())], lambda: run)
