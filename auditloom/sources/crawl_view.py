"""A crawl made of the test pages: each page gets a report, a status, headers and head tags from its number, so that every rule occurs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(n: Column, cases: dict, default) -> Column:
    out = None
    for value, result in cases.items():
        out = F.when(n == value, F.lit(result)) if out is None else out.when(n == value, F.lit(result))
    return out.otherwise(F.lit(default))


def responses(pages: DataFrame) -> DataFrame:
    """The RESPONSE columns of pages (page_id, html)."""
    i = F.col("page_id")
    report = i % 7 + 1
    site = F.concat(F.lit("http://site"), report.cast("string"), F.lit(".example.com"))
    html = F.col("html")
    html = F.when(i % 13 == 4, F.regexp_replace(html, "<title>[^<]*</title>", "<title></title>")).when(i % 13 == 6, F.replace(html, F.lit("</title>"), F.lit(" x" * 40 + "</title>"))).otherwise(html)
    html = F.when(i % 8 == 5, F.replace(F.replace(html, F.lit("<h1>"), F.lit("<h3>")), F.lit("</h1>"), F.lit("</h3>"))).otherwise(html)
    meta = F.concat(F.lit('<meta name="description" content="'), F.trim(F.substring(F.lit("lorem ipsum " * 20), F.lit(1), (i % 5 * 45).cast("int"))), F.lit('">'))
    head = F.concat(
        F.when(i % 4 != 0, meta).otherwise(""),
        F.when(i % 3 != 0, F.concat(F.lit('<link rel="canonical" href="'), site, F.lit("/p/"), i.cast("string"), F.lit('">'))).otherwise(""),
        F.when(i % 10 == 1, F.lit('<meta name="robots" content="NOINDEX,nofollow">')).otherwise(""),
        F.when(i % 2 == 0, F.lit('<meta property="og:title" content="t">')).otherwise(""),
        F.when(i % 6 == 0, F.lit('<meta property="og:description" content="">')).otherwise(""),
        F.lit("</head>"),
    )
    images = _pick(i % 4, {1: '<img src="a.png">', 2: '<img src="a.png" alt="a"><img src="b.png" alt=" ">', 3: '<img src="a.png" alt="a">'}, "")
    link = lambda n, more="": F.concat(F.lit('<a href="/p/'), (i + n).cast("string"), F.lit(f'{more}">x</a>'))
    body = F.concat(F.when(i % 8 == 2, F.lit("<h1>Second</h1>")).otherwise(""), images, link(7), link(14, "?x=1#f"), link(21, "/"), link(28), link(42), F.lit('<a href="https://cdn.example.org/x">x</a><a href="mailto:a@b.c">x</a></article>'))
    html = F.replace(F.replace(html, F.lit("</head>"), head), F.lit("</article>"), body)
    hops = F.when(i % 20 == 11, i % 3 + 1).otherwise(0).cast("int")
    page = lambda n: F.concat(site, F.lit("/p/"), n.cast("string"))
    return pages.select(
        report.cast("bigint").alias("report"),
        i.alias("page_id"),
        page(i).alias("url"),
        _pick(i % 20, {3: 404, 7: 500, 11: 301, 13: 0}, 200).cast("int").alias("status_code"),
        _pick(i % 11, {5: "application/pdf", 6: ""}, "Text/HTML; charset=UTF-8").alias("content_type_header"),
        html.alias("html"),
        hops.alias("redirect_hops"),
        F.when(hops > 0, page(i + 7)).otherwise("").alias("redirect_target"),
        F.when(hops > 0, page(i + 7 * hops)).otherwise("").alias("redirect_final_url"),
        (i * 37 % 900).alias("load_time"),
        F.when(i % 20 == 13, F.lit("cURL error 28: Operation timed out")).otherwise("").alias("fetch_error"),
    )


#: Markup on which careless patterns fail, by the page's number modulo 6: (what is replaced, by what).
ODD = [
    ("<article>", """<article><img title="a > b" alt="c"><img alt='' src=x><a title='1>0' href="/x?a=1&amp;b=2">l &#8211; k</a>"""),
    ("</head>", """<meta data-x=" name=y" name="description" content='say "x > y" &eacute; &hellip;'></head>"""),
    ("<title>", "<title>A &#8211; B &eacute;&#x26; "),
    ("<body>", ""),
    ("<h1>", '<h1 class="a>b" id=it\'s>Odd &lt;b&gt; one '),
    ("<article>", """<article><p data-a='<a href="/no">'>it's &amp; &copy &bogus; 5 < 6 <b>bold</b></p><a class="a=b" href = /y>m</a><h2 title="<h2>">t</h2>"""),
]


def odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read() with ODD markup in each page."""
    i, html = F.col("page_id") % len(ODD), F.col("html")
    return read(spark, sf_dir).withColumn("html", reduce(lambda c, x: F.when(i == x[0], F.replace(html, F.lit(x[1][0]), F.lit(x[1][1]))).otherwise(c), enumerate(ODD), html))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
