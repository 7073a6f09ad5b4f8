"""On-page facts by regular expressions: all lookups are flat, so no tree is needed and everything stays in the JVM.

Comments, scripts and styles are cut out before tags are matched; words are counted with scripts, as text. Quoted values
may hold any character, attributes are read from the left, and character references are decoded. A loop of a pattern
has a bound, since Java recurses in it: a tag of more than MOST_ATTRIBUTES values isn't seen as one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import decode_entities, present, trim, word_count
from auditloom.functions.urls import absolute, host, is_eligible_link

COMMENTS = r"(?is)<!--.*?-->"
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
MOST_ATTRIBUTES = 200
#: What follows a tag's name up to its end: runs without = and >, and values, of which quoted ones may hold a >.
INSIDE = r"[^>=]*(?:=(?:\s*\"[^\"]*\"|\s*'[^']*')?[^>=]*){0,%d}+" % MOST_ATTRIBUTES
ANY_TAG = rf"(?is)</?[a-z]{INSIDE}>|<[!?][^>]*>"
#: What PHP-like stripping of decoded text takes for a tag.
LOOKS_LIKE_TAG = r"(?s)<[^\s>][^>]*(?:>|\z)"
VALUE = r"\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*"
BEFORE = rf"(?is)^<[^\s/>]+(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:{VALUE}))?){{0,{MOST_ATTRIBUTES}}}?[\s/]+"
READ_TAGS = "h1 h2 meta link img a".split()


def cleaned(html: Column) -> Column:
    return F.regexp_replace(present(html), UNREAD, "")


def read_tags(clean: Column) -> Column:
    """Array of (name, tag): the start tags of READ_TAGS, in order. All tags are matched, so that none is found within another's value."""
    found = F.regexp_extract_all(clean, F.lit(rf"(?is)<[a-z]{INSIDE}>"), F.lit(0))
    named = F.transform(found, lambda t: F.struct(F.lower(F.regexp_extract(t, "^<([^\\s/>]+)", 1)).alias("name"), t.alias("tag")))
    return F.filter(named, lambda t: t["name"].isin(READ_TAGS))


def tags(read: Column, name: str) -> Column:
    """Those of read_tags() with this name."""
    return F.transform(F.filter(read, lambda t: t["name"] == name), lambda t: t["tag"])


def count_tags(read: Column, name: str) -> Column:
    return F.size(F.filter(read, lambda t: t["name"] == name)).cast("bigint")


def attribute(tag: Column, name: str) -> Column:
    """Its value, quoted in either way or bare; empty if there is none. Of repeated attributes the first counts."""
    raw = F.regexp_extract(tag, rf"{BEFORE}{name}\s*=\s*({VALUE})", 1)
    return decode_entities(F.regexp_replace(raw, r"(?s)^([\"'])(.*)\1\z", "$2"))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"{BEFORE}{name}[\s/=>]")


def first_content(tag_list: Column, key: str, value: str, wanted: str) -> Column:
    """The attribute `wanted` of the first tag that has it and whose `key` is `value`; null if there is none."""
    return F.get(F.transform(F.filter(tag_list, lambda t: (attribute(t, key) == value) & has_attribute(t, wanted)), lambda t: attribute(t, wanted)), F.lit(0))


def element_text(clean: Column, name: str) -> Column:
    """Trimmed text of the first such element."""
    return trim(decode_entities(F.regexp_replace(F.regexp_extract(clean, rf"(?is)<{name}(?:[\s/]{INSIDE})?>(.*?)</{name}\s*>", 1), ANY_TAG, "")))


def body_source(html: Column) -> Column:
    """The markup of a page's body. Without a body tag, all but the head, titles, scripts and styles."""
    plain = F.regexp_replace(present(html), COMMENTS, "")
    marked = F.regexp_extract(plain, rf"(?is)<body(?:[\s/]{INSIDE})?>(.*?)(?:</body\s*>|\z)", 1)
    implied = F.regexp_replace(plain, r"(?is)<head[\s>].*?</head\s*>|<(title|script|style)\b.*?</\1\s*>", "")
    return F.when(plain.rlike(r"(?i)<body[\s/>]"), marked).otherwise(implied)


def body_text(source: Column) -> Column:
    return decode_entities(F.regexp_replace(source, ANY_TAG, ""))


def text_words(text: Column) -> Column:
    """Words of a body's text; what looks like a tag in it isn't read."""
    return word_count(F.regexp_replace(text, LOOKS_LIKE_TAG, ""))


def links(anchors: Column, url: Column) -> Column:
    """Array of (url, internal) of the eligible links among these tags, in order."""
    hrefs = F.transform(anchors, lambda t: trim(attribute(t, "href")))
    full = F.transform(F.filter(hrefs, is_eligible_link), lambda h: absolute(h, url))
    return F.transform(full, lambda u: F.struct(u.alias("url"), (host(u) == host(url)).alias("internal")))
