"""On-page facts by the standard library's HTML parser, to hold the patterns of functions.html against.

A page costs some milliseconds of Python, so use it for samples and comparisons.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import urls as U
from auditloom.functions.text import NAMED, TRIMMED

#: An ampersand that starts no number and no known name with its semicolon: the audited product's parser leaves it as text.
_PLAIN_AMPERSAND = re.compile(rf"&(?!#[0-9]|#[xX][0-9A-Fa-f]|(?:{'|'.join(NAMED)});)")
#: Elements before which, and in which, no body is implied.
_HEAD = frozenset("html head title meta link base script style".split())

_DDL = "page_id bigint, page_title string, meta_description string, h1_count bigint, h1_text string, h2_count bigint, canonical_url string, robots_noindex boolean, robots_nofollow boolean, images_total bigint, images_missing_alt bigint, hrefs array<string>, word_count bigint, has_og_title boolean, has_og_description boolean"

_NAMES = [c.split()[0] for c in _DDL.split(", ")]
_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[c.split()[1]] for c in _DDL.split(", ")]


class Facts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.counts = {"h1": 0, "h2": 0, "img": 0}
        self.missing_alt, self.hrefs, self.metas, self.canonical = 0, [], [], None
        self.text: dict[str, list[str] | None] = {"title": None, "h1": None}
        self.open: dict[str, bool] = {"title": False, "h1": False}
        self.body: list[str] | None = None
        self.in_body = False
        self.in_head: str | None = None  # the title, script or style that is open before the body

    def begin_body(self) -> None:
        if self.body is None:
            self.body, self.in_body = [], True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag in self.counts:
            self.counts[tag] += 1
        if tag == "img":
            self.missing_alt += not own.get("alt", "").strip(TRIMMED)
        if tag == "a" and "href" in own:
            self.hrefs.append(own["href"].strip(TRIMMED))
        if tag == "meta" and "content" in own:
            self.metas.append(own)
        if tag == "link" and own.get("rel") == "canonical" and "href" in own and self.canonical is None:
            self.canonical = own["href"].strip(TRIMMED)
        if tag not in _HEAD:
            self.begin_body()
        elif self.body is None and tag in ("title", "script", "style"):
            self.in_head = tag
        if tag in self.text and self.text[tag] is None:
            self.text[tag], self.open[tag] = [], True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            self.open[tag] = False
        if tag == self.in_head:
            self.in_head = None
        if tag == "body":
            self.in_body = False

    def handle_data(self, data: str) -> None:
        for tag, is_open in self.open.items():
            if is_open:
                self.text[tag].append(data)
        if data.strip() and not self.in_head:
            self.begin_body()
        if self.in_body:
            self.body.append(data)

    def meta(self, key: str, value: str) -> str | None:
        return next((m["content"] for m in self.metas if m.get(key) == value), None)


def facts_of(html: str | None) -> tuple:
    p = Facts()
    p.feed(_PLAIN_AMPERSAND.sub("&amp;", html or ""))
    p.close()
    joined = lambda parts: "".join(parts or []).strip(TRIMMED)
    words = re.sub(r"^['-]+|-\Z", "", re.sub(r"<[^\s>][^>]*(?:>|\Z)", "", "".join(p.body or [])))
    robots = (p.meta("name", "robots") or "").lower()
    return (
        joined(p.text["title"]), (p.meta("name", "description") or "").strip(TRIMMED), p.counts["h1"], joined(p.text["h1"])[:200], p.counts["h2"], p.canonical or "", "noindex" in robots, "nofollow" in robots,
        p.counts["img"], p.missing_alt, p.hrefs, len(re.findall("[A-Za-z'-]+", words)), p.meta("property", "og:title") is not None, p.meta("property", "og:description") is not None,
    )


def fact_batches(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Facts of a batch (page_id, html) by so many rows at once: no more documents than one are held as text, and few rows wait to be sent."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        facts = [(i.as_py(), *facts_of(h.as_py())) for i, h in zip(part.column("page_id"), part.column("html"))]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*facts), _TYPES)], names=_NAMES)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and the facts of pages (page_id, url, html), as those of audit.extracted; hrefs are all link targets, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fact_batches(batch)

    found = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(run, _DDL)
    rows = found.join(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url"), "page_id")
    full = F.transform(F.filter("hrefs", U.is_eligible_link), lambda h: U.absolute(h, F.col("url")))
    rows = rows.withColumn("_internal", F.transform(full, lambda u: U.host(u) == U.host(F.col("url"))))
    count = lambda wanted: F.size(F.filter("_internal", lambda x: x == wanted)).cast("bigint")
    return rows.withColumn("links_internal", count(F.lit(True))).withColumn("links_external", count(F.lit(False))).drop("_internal", "url")
