"""URL algebra as string columns. It follows the audited product, not the URL standard: dots aren't folded, ports and queries are dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import bound, present, trim

#: Scheme, host and path of an absolute URL.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)"
#: Extensions of what isn't crawled.
SKIPPED = "pdf doc docx xls xlsx ppt pptx zip rar 7z jpg jpeg png gif svg webp avif mp4 mp3 wav mov avi wmv txt csv xml json".split()
#: Prefixes of links that lead nowhere.
DEAD_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def or_else(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def is_absolute(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def rtrim_slash(url: Column) -> Column:
    return F.regexp_replace(url, r"/+\z", "")


#: scheme://host of an absolute URL, and the rest of one after its path's trailing slashes are gone.
SITE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?.*\z"
WHOLE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*?)/*(?:[?#].*)?\z"

#: URLs that normalize() leaves as they are; most are.
NORMAL = r"^https?://[A-Za-z0-9.-]+/[^?#\s\x00]*[^/?#\s\x00]\z"


def resolve_relative(relative: Column, base: Column) -> Column:
    known = base.rlike(SITE)
    site = F.when(known, F.regexp_replace(base, SITE, "$1://$2")).otherwise("https://")
    folder = rtrim_slash(F.regexp_replace(path(base), r"/[^/]*/?\z", ""))
    return (
        F.when(relative.startswith("//"), F.concat(or_else(scheme(base), "https"), F.lit(":"), relative))
        .when(relative.startswith("/"), F.concat(site, relative))
        .otherwise(F.concat(site, folder, F.lit("/"), relative))
    )


def absolute(url: Column, base: Column) -> Column:
    return F.when(is_absolute(url), url).otherwise(resolve_relative(url, base))


def normalize(url: Column, base: Column) -> Column:
    """scheme://host/path without query, fragment, port and trailing slash; null if that's no URL."""

    def rooted(clean: Column) -> Column:
        # What isn't a URL stays as it was and has no host; a URL without a path gets its root.
        return F.when(clean.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]+\z"), F.concat(clean, F.lit("/"))).when(clean.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]+/"), clean)

    bare = trim(F.regexp_replace(url, "#.*$", ""))
    slow = bound(bare, lambda b: F.when(b != "", bound(F.regexp_replace(absolute(b, base), WHOLE, "$1://$2$3"), rooted)))
    return F.when(url.rlike(NORMAL), url).otherwise(slow)


def normalize_stored(url: Column) -> Column:
    return F.coalesce(normalize(url, url), url)


def same_domain(url: Column, base: Column) -> Column:
    return host(url) == host(base)


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"\.([^./]*)\z", 1)


def is_skipped(url: Column) -> Column:
    return extension(url).isin(SKIPPED)


def is_eligible_link(href: Column) -> Column:
    dead = href == ""
    for p in DEAD_PREFIXES:
        dead = dead | href.startswith(p)
    return ~dead


def content_type(header: Column) -> Column:
    return F.lower(trim(F.split_part(present(header), F.lit(";"), F.lit(1))))


def is_html_type(ctype: Column, url: Column) -> Column:
    return F.when(ctype == "", ~is_skipped(url)).otherwise(ctype.contains("text/html") | ctype.contains("application/xhtml+xml"))


def robots_sitemaps(body: Column, robots_url: Column) -> Column:
    """Distinct absolute sitemap URLs that a robots.txt names, in order."""
    named = F.filter(F.split(present(body), r"\r\n|\n|\r"), lambda x: x.rlike(r"(?i)^\s*sitemap\s*:\s*.+$"))
    found = F.filter(F.transform(named, lambda x: trim(F.regexp_extract(x, r"(?i)^\s*sitemap\s*:\s*(.+)$", 1))), lambda x: x != "")
    return F.array_distinct(F.transform(found, lambda x: absolute(x, robots_url)))


def sitemap_candidates(sitemaps: Column, base_url: Column) -> Column:
    base = rtrim_slash(base_url)
    return F.array_union(sitemaps, F.array(F.concat(base, F.lit("/sitemap.xml")), F.concat(base, F.lit("/sitemap_index.xml"))))
