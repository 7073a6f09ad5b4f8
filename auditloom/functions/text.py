"""String columns: trimming, entities, words, slugs, escapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are trimmed (no-break spaces are not among them).
TRIMMED = " \t\n\r\x0b\x00"
#: The character references that HTML 4 names, as the standard library lists them, and the apostrophe.
NAMED = {**name2codepoint, "apos": 39}
#: References that are decoded: numbers, with or without a semicolon, and known names with one, as the audited product's parser does.
REFERENCE = "&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]*;"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once however often body has it; written out, each mention would be computed by itself."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(c: Column) -> Column:
    """The column with nulls as empty strings."""
    return F.coalesce(c, F.lit(""))


def character(number: Column) -> Column:
    """The character of a code point; empty if it is none."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("")


def decode_entities(c: Column) -> Column:
    """c with its character references decoded, each once."""
    points = F.str_to_map(F.lit(",".join(f"&{name};:{point}" for name, point in NAMED.items())), F.lit(","), F.lit(":"))
    digits = lambda r: F.regexp_extract(r, "^&#[xX]?([0-9A-Fa-f]+)", 1)

    def one(r: Column) -> Column:
        number = F.when(F.lower(r).startswith("&#x"), F.conv(digits(r), 16, 10)).when(r.startswith("&#"), digits(r)).otherwise(F.try_element_at(points, r)).cast("bigint")
        return F.when(number.isNotNull(), character(number)).otherwise(r)

    def pieces(x: Column) -> Column:
        return F.zip_with(F.split(x, REFERENCE), F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0)), lambda p, r: F.concat(p, F.coalesce(one(r), F.lit(""))))

    return bound(c, lambda x: F.when(x.contains("&"), F.array_join(pieces(x), "")).otherwise(x))


def word_count(text: Column) -> Column:
    """Runs of ASCII letters, apostrophes and hyphens; apostrophes and hyphens that lead the text, and a hyphen that ends it, don't count."""
    core = F.regexp_replace(text, r"^['-]+|-\z", "")
    return F.regexp_count(core, F.lit("[A-Za-z'-]+")).cast("bigint")


@cache
def plain_characters() -> tuple[str, str]:
    """Two texts for translate(): the characters that have a case or an accent, then what they are without; marks stand last and become nothing."""
    pairs, marks = [], []
    for char in map(chr, (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0100, 0xE01F0))):
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c)[0] != "M")
        base = "".join(c.lower()[0] for c in unicodedata.normalize("NFC", base))
        if not base:
            marks.append(char)
        elif base != char:
            pairs.append((char, base))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def plain(c: Column) -> Column:
    """c in lower case and without accents, character by character; parts of Korean syllables aren't put together."""
    return F.translate(c, *plain_characters())


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.lower(present(title)), "[^a-z0-9]+", "-")
    return F.when(s == "", F.lit("report")).otherwise(s)


#: Names of exported files, by kind.
FILE_NAMES = {"report": "seo-report-%d-%s", "issues": "seo-issues-%d-%s"}


def export_filename(kind: str, uid: Column, title: Column, extension: str) -> Column:
    """kind: 'report' or 'issues'."""
    return F.format_string(f"{FILE_NAMES[kind]}.{extension}", uid, slug(title))


def escape_html(c: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), pairs, c)


def csv_field(c: Column) -> Column:
    """A CSV field, quoted if it holds a delimiter, quote, backslash or white space; quotes are doubled."""
    return F.when(c.rlike(r'[,"\\ \t\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def parse_header_lines(lines: Column) -> Column:
    """`name: value` lines as a map from lower-case name to its values in order; other lines are left out."""
    pairs = F.filter(lines, lambda x: x.contains(":"))
    named = F.transform(pairs, lambda x: F.struct(F.lower(trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("name"), trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)", 1)).alias("value")))
    names = F.array_distinct(F.transform(named, lambda x: x["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(named, lambda x: x["name"] == n), lambda x: x["value"])))


def is_timeout(message: Column) -> Column:
    """Whether a fetch error calls for another attempt over IPv4."""
    m = F.lower(message)
    return m.contains("curl error 28") | m.contains("ssl connection timeout") | m.contains("operation timed out")
