"""The audit queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import html as H
from auditloom.functions import text as T
from auditloom.functions import urls as U
from auditloom.operators import crawl, crosspage, export, extract_dom, guard, scoring, sitechecks
from auditloom.operators import reports as R
from auditloom.operators.audit import audited, classified, extracted
from auditloom.plans import sql as S
from auditloom.sources import crawl_view, derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query with its SQL. Whole numbers come out as bigint, as they do in the SQL."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))

        key = name or fn.__name__
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return register


def pages(spark, sf_dir):
    return audited(crawl_view.read(spark, sf_dir))


_STORED: dict[tuple, DataFrame] = {}


def stored(spark, sf_dir):
    """Audited pages as a written table that the queries of a session share, as long as the pages aren't written anew.

    Checks across pages read them several times; so documents are parsed once.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/pages.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen()
    if key not in _STORED:
        _STORED[key] = crawl.written(pages(spark, sf_dir), "pages")
    return _STORED[key]


def checked(spark, sf_dir):
    return crosspage.checked(stored(spark, sf_dir))


def facts(spark, sf_dir):
    return extracted(classified(crawl_view.read(spark, sf_dir)))


# ---------------------------------------------------------------- URLs
def _values(items: list[str], name: str) -> str:
    return f"(VALUES {', '.join(f'({i}, {S.q(v)})' for i, v in enumerate(items))}) v(n, {name})"


_BASE = S.q(derived.BASE)


@query(f"SELECT page_id, {S.normalize('url', 'url')} AS normalized FROM pages UNION ALL SELECT -1 - n, {S.normalize('u', _BASE)} FROM {_values(derived.URLS, 'u')}")
def url_normalize(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own = raw.select("page_id", U.normalize(F.col("url"), F.col("url")).alias("normalized"))
    base = F.lit(derived.BASE)
    return own.unionByName(derived.literals(spark, derived.URLS, "u").select((-1 - F.col("n")).alias("page_id"), U.normalize(F.col("u"), base).alias("normalized")))


def _urls(spark, sf_dir):
    """n, u: URLS, numbered below 0, and the URLs of all pages, whole and without their sites."""
    rows = derived.literals(spark, derived.URLS, "u").select((-1 - F.col("n")).alias("n"), "u")
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"), "url")
    return rows.unionByName(own.select("n", F.explode(F.array("url", F.regexp_replace("url", "^[a-z]+://[^/]*", ""))).alias("u")))


_URLS = f"(SELECT -1 - n AS n, u FROM {_values(derived.URLS, 'u')} UNION ALL SELECT page_id, unnest([url, regexp_replace(url, '^[a-z]+://[^/]*', '')]) FROM pages)"


@query(f"SELECT n, {S.resolve('u', _BASE)} AS resolved, {S.resolve('u', S.q('https://h.com/a/'))} AS in_folder FROM {_URLS}")
def url_resolve(spark, sf_dir):
    rows = _urls(spark, sf_dir)
    return rows.select("n", U.resolve_relative(F.col("u"), F.lit(derived.BASE)).alias("resolved"), U.resolve_relative(F.col("u"), F.lit("https://h.com/a/")).alias("in_folder"))


@query(f"SELECT page_id, {S.part('url', 1)} AS scheme, {S.part('url', 2)} AS host, {S.part('url', 3)} AS path FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"))


@query(rf"""WITH {S.REFS}, c AS (SELECT page_id, url, ref_names, ref_chars, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS clean FROM pages, refs),
    h AS (SELECT page_id, url, list_transform(list_filter({S.tags("a")}, lambda x: {S.has_attribute("x", "href")}), lambda x: {S.trim(S.attribute("x", "href"))}) AS hrefs FROM c),
    u AS (SELECT page_id, url, list_transform(list_filter(hrefs, lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, 'mailto:') AND NOT starts_with(x, 'tel:') AND NOT starts_with(x, 'javascript:')), lambda x: {S.absolute("x", "url")}) AS urls FROM h)
    SELECT page_id, CAST(len(list_filter(urls, lambda x: {S.part("x", 2)} = {S.part("url", 2)})) AS BIGINT) AS internal, CAST(len(list_filter(urls, lambda x: {S.part("x", 2)} <> {S.part("url", 2)})) AS BIGINT) AS external,
        CAST(len(list_distinct(urls)) AS BIGINT) AS distinct_links FROM u""")
def link_classify(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", H.tags(H.read_tags(H.cleaned(F.col("html"))), "a").alias("a")).select("page_id", H.links(F.col("a"), F.col("url")).alias("l"))
    n = lambda cond: F.size(F.filter("l", cond)).cast("bigint")
    return rows.select("page_id", n(lambda x: x["internal"]).alias("internal"), n(lambda x: ~x["internal"]).alias("external"), F.size(F.array_distinct(F.transform("l", lambda x: x["url"]))).alias("distinct_links"))


@query(f"SELECT n, {S.skipped('(' + S.absolute('u', _BASE) + ')')} AS skipped, NOT (u = '' OR starts_with(u, '#') OR starts_with(u, 'mailto:') OR starts_with(u, 'tel:') OR starts_with(u, 'javascript:')) AS eligible FROM {_URLS}")
def skip_extension_filter(spark, sf_dir):
    u = F.col("u")
    return _urls(spark, sf_dir).select("n", U.is_skipped(U.absolute(u, F.lit(derived.BASE))).alias("skipped"), U.is_eligible_link(u).alias("eligible"))


# ---------------------------------------------------------------- facts of pages
@query(S.audit("SELECT page_id, kind, content_type, status_code, page_type FROM audited"))
def page_class(spark, sf_dir):
    p = stored(spark, sf_dir).select("page_id", "content_type", "status_code", "page_type")
    return classified(crawl_view.read(spark, sf_dir)).select("page_id", "kind").join(p, "page_id")


for _name, _columns in {
    "extract_title": "page_title, title_length",
    "extract_meta": "meta_description, meta_description_length",
    "extract_headings": "h1_count, h1_text, h2_count",
    "extract_canonical": "canonical_url",
    "extract_robots": "robots_noindex, robots_nofollow",
    "extract_images": "images_total, images_missing_alt",
    "extract_links": "links_internal, links_external",
    "extract_og": "has_og_title, has_og_description",
    "word_count": "word_count",
}.items():
    query(f"WITH {S.CRAWL}, {S.FACTS} SELECT page_id, {_columns} FROM rich", _name)(lambda spark, sf_dir, c=_columns.split(", "): facts(spark, sf_dir).select("page_id", *c))


_ALL_FACTS = "page_title, meta_description, h1_count, h1_text, h2_count, canonical_url, robots_noindex, robots_nofollow, images_total, images_missing_alt, links_internal, links_external, word_count, has_og_title, has_og_description"


@query(f"WITH {S.CRAWL}, {S.FACTS} SELECT page_id, {_ALL_FACTS} FROM rich WHERE kind = 'html'")
def extract_dom_tier(spark, sf_dir):
    """All facts of HTML pages by a parser instead of patterns."""
    own = classified(crawl_view.read(spark, sf_dir)).where("kind = 'html'")
    return extract_dom.extracted(own).select("page_id", *_ALL_FACTS.split(", "))


@query(S.odd(f"SELECT page_id, {_ALL_FACTS} FROM rich"))
def extract_odd_markup(spark, sf_dir):
    """All facts of pages with markup on which careless patterns fail."""
    return extracted(classified(crawl_view.odd(spark, sf_dir))).select("page_id", *_ALL_FACTS.split(", "))


@query(S.odd(f"SELECT page_id, {_ALL_FACTS} FROM rich WHERE kind = 'html'"))
def extract_odd_markup_dom(spark, sf_dir):
    return extract_dom.extracted(classified(crawl_view.odd(spark, sf_dir)).where("kind = 'html'")).select("page_id", *_ALL_FACTS.split(", "))


@query(S.cross("SELECT report, page_id, CAST(x.pos AS BIGINT) AS pos, x.url AS url FROM (SELECT report, page_id, unnest(list_transform(list_filter(internal_all, lambda x, i: list_position(internal_all, x) = i), lambda x, i: {'pos': i - 1, 'url': x})) AS x FROM audited)"))
def distinct_links(spark, sf_dir):
    return stored(spark, sf_dir).select("report", "page_id", F.posexplode("internal_links").alias("pos", "url"))


# ---------------------------------------------------------------- issues and scores
@query(S.cross("SELECT report, page_id, CAST(pos AS BIGINT) AS pos, i.type AS type, i.severity AS severity, i.message AS message FROM issue_rows"))
def page_issues(spark, sf_dir):
    return R.issue_rows(checked(spark, sf_dir)).select("report", "page_id", "pos", "type", "severity", "message")


RULES = (
    "fetch_error redirect http_error non_html_resource missing_title title_too_long title_too_short missing_meta_description meta_description_too_long meta_description_too_short missing_h1 multiple_h1 missing_canonical noindex "
    "images_missing_alt thin_content missing_og_title missing_og_description duplicate_title duplicate_meta_description broken_internal_links"
).split()
for _rule in RULES:
    query(S.cross(f"SELECT page_id, i.severity AS severity, i.message AS message FROM issue_rows WHERE i.type = '{_rule}'"), f"rule_{_rule}")(
        lambda spark, sf_dir, rule=_rule: R.issue_rows(checked(spark, sf_dir)).where(F.col("type") == rule).select("page_id", "severity", "message")
    )


@query(S.cross("SELECT report, page_id, page_score, old_score FROM final JOIN (SELECT page_id FROM audited) USING (page_id)"))
def page_score(spark, sf_dir):
    own = stored(spark, sf_dir)
    return crosspage.checked(own).select("report", "page_id", "page_score").join(own.select("page_id", F.col("page_score").alias("old_score")), "page_id")


_SUMMARY = "SELECT i.type AS type, first(i.severity ORDER BY page_score, page_id, pos) AS severity, first(i.message ORDER BY page_score, page_id, pos) AS message, count(*) AS count FROM issue_rows GROUP BY i.type"


@query(S.cross(_SUMMARY))
def issue_summary(spark, sf_dir):
    return R.issue_summary(checked(spark, sf_dir))


@query(S.cross("SELECT report, count(*) FILTER (page_type = 'html') AS html, count(*) FILTER (page_type = 'redirect') AS redirect, count(*) FILTER (page_type = 'resource') AS resource, count(*) FILTER (len(list_filter(issues, lambda x: x.severity = 'error')) > 0) AS with_errors FROM final GROUP BY report"))
def page_type_summary(spark, sf_dir):
    return R.page_type_summary(checked(spark, sf_dir))


@query(S.cross("SELECT report, count(*) FILTER (i.severity = 'error') AS errors, count(*) FILTER (i.severity = 'warning') AS warnings, count(*) FILTER (i.severity = 'notice') AS notices FROM final LEFT JOIN issue_rows USING (report, page_id) GROUP BY report"))
def severity_totals(spark, sf_dir):
    return R.severity_totals(checked(spark, sf_dir))


@query(S.cross("SELECT report, CAST(floor(sum(page_score) / count(*) + 0.5) AS BIGINT) AS overall_score FROM final GROUP BY report"))
def overall_score(spark, sf_dir):
    return crosspage.overall_scores(checked(spark, sf_dir))


@query(S.cross("SELECT * FROM dup_titles"))
def duplicate_titles(spark, sf_dir):
    return crosspage.duplicate_groups(stored(spark, sf_dir), "page_title")


@query(S.cross("SELECT * FROM dup_metas"))
def duplicate_meta(spark, sf_dir):
    return crosspage.duplicate_groups(stored(spark, sf_dir), "meta_description")


@query(S.cross("SELECT report, page_id, pos, url FROM broken"))
def broken_links(spark, sf_dir):
    return crosspage.broken_links(stored(spark, sf_dir))


@query(S.cross("SELECT report, page_id, message FROM messages"))
def broken_link_message(spark, sf_dir):
    return crosspage.broken_by_source(stored(spark, sf_dir)).select("report", "page_id", "message")


@query("SELECT n, CASE WHEN n = 1 THEN 'Page contains 1 broken internal link' ELSE 'Page contains ' || n || ' broken internal links' END || ': ' || array_to_string(list_transform(range(1, least(n, 3) + 1), lambda x: 'u' || x), ', ') || CASE WHEN n > 3 THEN ' (+' || (n - 3) || ' more)' ELSE '' END AS message FROM range(1, 7) t(n)")
def broken_message_forms(spark, sf_dir):
    urls = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: F.concat(F.lit("u"), x.cast("string")))
    return spark.range(1, 7).withColumnRenamed("id", "n").select("n", crosspage.broken_message(urls).alias("message"))


# ---------------------------------------------------------------- filters, sorts, lists
@query(S.cross("SELECT page_id FROM final WHERE contains(lower(url || ' ' || page_title || ' ' || array_to_string(list_transform(issues, lambda x: x.message), ' ')), 'chars') AND page_type = 'html' AND len(list_filter(issues, lambda x: x.severity = 'error')) > 0 AND len(list_filter(issues, lambda x: contains(x.type, 'title'))) > 0"))
def page_filter(spark, sf_dir):
    return R.filtered(checked(spark, sf_dir), " Chars ", "html", "error", "TITLE").select("page_id")


@query(S.cross("SELECT page_id, page_score FROM final WHERE report = 3 ORDER BY page_score, page_id LIMIT 10"))
def page_sort_topk(spark, sf_dir):
    return R.pages_of(checked(spark, sf_dir), 3).select("page_id", "page_score").limit(10)


@query(S.cross("SELECT page_id, CAST(row_number() OVER (ORDER BY word_count DESC, page_id) AS BIGINT) AS place FROM final ORDER BY 2 LIMIT 20"))
def column_sort(spark, sf_dir):
    from pyspark.sql import Window

    top = R.sorted_by(checked(spark, sf_dir), "word_count", ascending=False).select("page_id", "word_count").limit(20)
    return top.select("page_id", F.row_number().over(Window.orderBy(F.desc("word_count"), "page_id")).alias("place"))


@query(S.cross("SELECT page_id FROM final WHERE contains(lower(url), 'site2') OR contains(lower(page_title), 'site2')"))
def page_search(spark, sf_dir):
    return R.search(checked(spark, sf_dir), "SITE2", ["url", "page_title"]).select("page_id")


@query(S.reports("SELECT uid, queued_at, crdate FROM reports WHERE NOT deleted AND status = 4 ORDER BY queued_at, crdate, uid LIMIT 5"))
def queue_topk(spark, sf_dir):
    return R.queued(derived.reports(spark, sf_dir), 5).select("uid", "queued_at", "crdate")


@query(S.reports("SELECT uid, crdate FROM reports WHERE NOT deleted ORDER BY crdate DESC, uid DESC LIMIT 20"))
def reports_latest(spark, sf_dir):
    return R.latest(derived.reports(spark, sf_dir)).select("uid", "crdate").limit(20)


@query(S.reports("SELECT uid, title, base_url FROM reports WHERE NOT deleted AND uid = 7"))
def report_by_uid(spark, sf_dir):
    return R.by_uid(derived.reports(spark, sf_dir), 7).select("uid", "title", "base_url")


_LABEL = "CASE status WHEN 0 THEN 'New' WHEN 1 THEN 'Running' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Failed' WHEN 4 THEN 'Queued' ELSE 'Unknown' END"


@query(S.reports(f"SELECT uid, title, base_url, {_LABEL} AS status, pages_crawled, max_pages, CASE WHEN status = 2 THEN overall_score END AS score, strftime(make_timestamp(crdate * 1000000), '%d.%m.%Y %H:%M') AS created FROM reports"))
def report_list(spark, sf_dir):
    return R.list_view(derived.reports(spark, sf_dir))


@query(S.reports(f"SELECT uid, {_LABEL} AS label, CASE status WHEN 0 THEN 'secondary' WHEN 1 THEN 'info' WHEN 2 THEN 'success' WHEN 3 THEN 'danger' WHEN 4 THEN 'warning' ELSE 'secondary' END AS badge FROM reports"))
def status_labels(spark, sf_dir):
    s = F.col("status")
    return derived.reports(spark, sf_dir).select("uid", scoring.status_label(s).alias("label"), scoring.status_badge(s).alias("badge"))


@query(S.reports("SELECT uid, CASE WHEN overall_score >= 80 THEN 'success' WHEN overall_score >= 60 THEN 'warning' ELSE 'danger' END AS badge FROM reports"))
def score_badge(spark, sf_dir):
    return derived.reports(spark, sf_dir).select("uid", scoring.score_badge(F.col("overall_score")).alias("badge"))


@query("SELECT n * 50 AS status, CASE WHEN n * 50 >= 500 THEN 'danger' WHEN n * 50 >= 400 THEN 'warning' WHEN n * 50 >= 300 THEN 'info' ELSE 'success' END AS page, CASE WHEN n = 4 THEN 'success' WHEN n = 0 THEN 'secondary' WHEN n * 50 >= 400 THEN 'warning' ELSE 'info' END AS probe FROM range(0, 13) t(n)")
def http_status_class(spark, sf_dir):
    s = F.col("status")
    return spark.range(0, 13).select((F.col("id") * 50).alias("status")).select("status", scoring.http_class(s).alias("page"), scoring.probe_badge(s).alias("probe"))


@query(S.reports("SELECT uid, CAST(CASE WHEN max_pages <= 0 THEN 0 ELSE greatest(0, least(100, floor(100 * progress_pages / max_pages + 0.5))) END AS BIGINT) AS percent, CAST(greatest(1, least(200, max_pages)) AS BIGINT) AS budget FROM reports"))
def progress_percent(spark, sf_dir):
    return derived.reports(spark, sf_dir).select("uid", scoring.progress_percent(F.col("progress_pages"), F.col("max_pages")).alias("percent"), scoring.page_budget(F.col("max_pages")).alias("budget"))


@query(S.cross("SELECT page_id, CASE page_type WHEN 'html' THEN 'HTML' WHEN 'redirect' THEN 'Redirect' ELSE 'Resource' END AS label, CASE page_type WHEN 'html' THEN 'success' WHEN 'redirect' THEN 'info' ELSE 'secondary' END AS badge FROM final"))
def page_type_label(spark, sf_dir):
    return stored(spark, sf_dir).select("page_id", scoring.page_type_label(F.col("page_type")).alias("label"), scoring.page_type_badge(F.col("page_type")).alias("badge"))


# ---------------------------------------------------------------- state machine
_STALE = f"(status = 1 AND (started_at <= 0 OR ({derived.NOW} - started_at >= 30 AND pages_crawled <= 0 AND progress_pages <= 0 AND trim(last_crawled_url) = '')))"


@query(S.reports(f"SELECT uid FROM reports WHERE {_STALE}"))
def stale_runs(spark, sf_dir):
    return derived.reports(spark, sf_dir).where(R.is_stale(F.lit(derived.NOW))).select("uid")


@query(S.reports("SELECT uid, status NOT IN (1, 4) AS can_queue, status = 4 AS can_start FROM reports"))
def state_guard(spark, sf_dir):
    return derived.reports(spark, sf_dir).select("uid", R.can_queue().alias("can_queue"), R.can_start().alias("can_start"))


@query(S.reports(f"SELECT uid, CASE WHEN {_STALE} THEN 4 ELSE status END AS status, CASE WHEN {_STALE} THEN {derived.NOW} ELSE queued_at END AS queued_at, CASE WHEN {_STALE} THEN 0 ELSE started_at END AS started_at, CASE WHEN {_STALE} THEN 0 ELSE overall_score END AS overall_score FROM reports"))
def stale_reset(spark, sf_dir):
    return R.reset_stale(derived.reports(spark, sf_dir), F.lit(derived.NOW)).select("uid", "status", "queued_at", "started_at", "overall_score")


@query(S.reports(f"SELECT uid, CASE WHEN status NOT IN (1, 4) THEN 4 ELSE status END AS status, CASE WHEN status NOT IN (1, 4) THEN {derived.NOW} ELSE queued_at END AS queued_at, pages_crawled, CASE WHEN status NOT IN (1, 4) THEN '' ELSE error_message END AS error_message FROM reports"))
def queue_reports(spark, sf_dir):
    return R.queue(derived.reports(spark, sf_dir), F.lit(True), F.lit(derived.NOW)).select("uid", "status", "queued_at", "pages_crawled", "error_message")


@query(S.reports(f"SELECT uid, CASE WHEN status = 4 THEN 1 ELSE status END AS status, CASE WHEN status = 4 THEN {derived.NOW} ELSE started_at END AS started_at, CASE WHEN status = 4 THEN 0 ELSE pages_crawled END AS pages_crawled FROM reports"))
def start_reports(spark, sf_dir):
    return R.start(derived.reports(spark, sf_dir), F.lit(True), F.lit(derived.NOW)).select("uid", "status", "started_at", "pages_crawled")


@query(S.cross(f"""SELECT r.uid, CASE WHEN r.status = 1 THEN 2 ELSE r.status END AS status, CAST(CASE WHEN r.status = 1 THEN coalesce(n, 0) ELSE r.pages_crawled END AS BIGINT) AS pages_crawled,
    CAST(CASE WHEN r.status = 1 THEN coalesce(s, 0) ELSE r.overall_score END AS BIGINT) AS overall_score FROM (WITH {S.REPORTS} SELECT * FROM reports) r
    LEFT JOIN (SELECT report, count(*) AS n, floor(sum(page_score) / count(*) + 0.5) AS s FROM final GROUP BY report) p ON p.report = r.uid"""))
def finish_reports(spark, sf_dir):
    done = crawl.written(checked(spark, sf_dir), "checked")
    return R.finish(derived.reports(spark, sf_dir), done, crosspage.overall_scores(done), F.lit(derived.NOW)).select("uid", "status", "pages_crawled", "overall_score")


@query(S.reports("SELECT uid, title FROM reports WHERE status <> 3"))
def delete_reports(spark, sf_dir):
    rows = derived.reports(spark, sf_dir)
    return R.without_reports(rows, rows.where("status = 3"), "uid").select("uid", "title")


@query(S.reports(f"SELECT uid, 'Processing report #' || uid || ': ' || title AS begins, 'Status: ' || {_LABEL} || ', pages crawled: ' || pages_crawled || ', score: ' || overall_score || '/100' AS ends FROM reports"))
def status_lines(spark, sf_dir):
    return R.status_lines(derived.reports(spark, sf_dir))


# ---------------------------------------------------------------- exports
def _counts(s: str) -> str:
    return f"CAST(len(list_filter(issues, lambda x: x.severity = '{s}')) AS VARCHAR)"


_PAGE_ROW = f"""SELECT report, page_id, page_score, url, CASE page_type WHEN 'html' THEN 'HTML' WHEN 'redirect' THEN 'Redirect' ELSE 'Resource' END AS page_type_label, CAST(status_code AS VARCHAR) AS status_code, content_type,
    CASE WHEN kind = 'redirect' THEN 'http://site' || report || '.example.com/p/' || (page_id + 7) ELSE '' END AS redirect_target, CASE WHEN kind = 'redirect' THEN 'http://site' || report || '.example.com/p/' || (page_id + 7 * redirect_hops) ELSE '' END AS redirect_final_url,
    CAST(redirect_hops AS VARCHAR) AS redirect_hops, CAST(page_score AS VARCHAR) AS score, {_counts("error")} AS errors, {_counts("warning")} AS warnings, {_counts("notice")} AS notices, page_title AS title,
    CAST(title_length AS VARCHAR) AS title_length, meta_description, CAST(meta_description_length AS VARCHAR) AS meta_description_length, CAST(h1_count AS VARCHAR) AS h1_count, h1_text, CAST(h2_count AS VARCHAR) AS h2_count, canonical_url,
    CASE WHEN robots_noindex THEN 'yes' ELSE 'no' END AS robots_noindex, CASE WHEN robots_nofollow THEN 'yes' ELSE 'no' END AS robots_nofollow, CAST(images_total AS VARCHAR) AS images_total, CAST(images_missing_alt AS VARCHAR) AS images_missing_alt,
    CAST(links_internal AS VARCHAR) AS links_internal, CAST(links_external AS VARCHAR) AS links_external, CAST(word_count AS VARCHAR) AS word_count, CAST(load_time AS VARCHAR) AS load_time,
    array_to_string(list_transform(issues, lambda x: x.type), ' | ') AS issue_types, array_to_string(list_transform(issues, lambda x: x.message), ' | ') AS issue_messages FROM final"""


@query(S.cross(_PAGE_ROW))
def export_pages_rows(spark, sf_dir):
    return export.page_rows(checked(spark, sf_dir))


def _field(c: str) -> str:
    return rf"""CASE WHEN regexp_matches({c}, '[,"\\ \t\r\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


_PAGE_FIELDS = "url page_type_label status_code content_type redirect_target redirect_final_url redirect_hops score errors warnings notices title title_length meta_description meta_description_length h1_count h1_text h2_count canonical_url robots_noindex robots_nofollow images_total images_missing_alt links_internal links_external word_count load_time issue_types issue_messages".split()


@query(f"SELECT report, page_id, page_score, {' || chr(44) || '.join('(' + _field(c) + ')' for c in _PAGE_FIELDS)} AS line FROM ({S.cross(_PAGE_ROW)})")
def export_pages_lines(spark, sf_dir):
    return export.page_lines(checked(spark, sf_dir))


@query(f"SELECT {_field('type')} || ',' || {_field('severity')} || ',' || {_field('message')} || ',' || count AS line FROM ({S.cross(_SUMMARY)})")
def export_issues_rows(spark, sf_dir):
    return export.issue_lines(checked(spark, sf_dir))


@query(S.cross("SELECT report, page_id, page_score, url, page_type AS kind, title_length AS n, CAST(len(issues) AS BIGINT) AS n_issues, issues[1].type AS first_type FROM final"))
def export_json_rows(spark, sf_dir):
    """Each page's object, written as JSON and parsed again."""
    rows = export.page_json(checked(spark, sf_dir))
    schema = rows.schema["page"].dataType
    back = rows.select("report", "page_id", "page_score", F.from_json(F.to_json("page"), schema).alias("p"))
    return back.select("report", "page_id", "page_score", "p.url", F.col("p.pageType").alias("kind"), F.col("p.titleLength").alias("n"), F.size("p.issues").alias("n_issues"), F.get("p.issues", F.lit(0))["type"].alias("first_type"))


_PAGE_OBJECT = """{'url': url, 'pageType': page_type, 'pageTypeLabel': CASE page_type WHEN 'html' THEN 'HTML' WHEN 'redirect' THEN 'Redirect' ELSE 'Resource' END, 'statusCode': CASE WHEN kind = 'failed' THEN 0 ELSE status_code END, 'contentType': content_type,
    'redirectTarget': CASE WHEN kind = 'redirect' THEN 'http://site' || report || '.example.com/p/' || (page_id + 7) ELSE '' END, 'redirectFinalUrl': CASE WHEN kind = 'redirect' THEN 'http://site' || report || '.example.com/p/' || (page_id + 7 * redirect_hops) ELSE '' END,
    'redirectHops': redirect_hops, 'score': page_score, 'errorCount': len(list_filter(issues, lambda x: x.severity = 'error')), 'warningCount': len(list_filter(issues, lambda x: x.severity = 'warning')), 'noticeCount': len(list_filter(issues, lambda x: x.severity = 'notice')),
    'title': page_title, 'titleLength': title_length, 'metaDescription': meta_description, 'metaDescriptionLength': meta_description_length, 'h1Count': h1_count, 'h1Text': h1_text, 'h2Count': h2_count, 'wordCount': word_count, 'loadTime': load_time, 'issues': issues}"""
_HEAD_OBJECT = f"{{'uid': uid, 'title': title, 'baseUrl': base_url, 'status': {_LABEL}, 'overallScore': overall_score, 'pagesCrawled': pages_crawled, 'maxPages': max_pages}}"


@query(
    S.cross(f"""SELECT report AS uid, 'page' AS kind, page_score, page_id, CAST(to_json({_PAGE_OBJECT}) AS VARCHAR) AS json FROM final WHERE report IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT uid, 'report', -1, -1, CAST(to_json({{'report': {_HEAD_OBJECT}, 'issuesSummary': coalesce(s, [])}}) AS VARCHAR) FROM (WITH {S.REPORTS} SELECT * FROM reports) r LEFT JOIN (
        SELECT report, list({{'type': type, 'severity': severity, 'message': message, 'count': n}} ORDER BY n DESC, first) AS s FROM (
            SELECT report, i.type AS type, first(i.severity ORDER BY page_score, page_id, pos) AS severity, first(i.message ORDER BY page_score, page_id, pos) AS message, count(*) AS n, min((page_score, page_id, pos)) AS first FROM issue_rows GROUP BY report, i.type) GROUP BY report) g ON g.report = r.uid""")
)
def export_json_documents(spark, sf_dir):
    """The parts of the JSON documents of all reports: heads with issue summaries, and pages."""
    return export.json_lines(derived.reports(spark, sf_dir), checked(spark, sf_dir))


@query(S.reports("SELECT uid, 'seo-report-' || uid || '-' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '.csv' AS pages, 'seo-issues-' || uid || '-' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '.csv' AS issues FROM reports"))
def export_slug(spark, sf_dir):
    name = lambda kind: T.export_filename(kind, F.col("uid"), F.col("title"), "csv")
    return derived.reports(spark, sf_dir).select("uid", name("report").alias("pages"), name("issues").alias("issues"))


# ---------------------------------------------------------------- sites, redirects, guard
_SITE_BODIES = ", ".join(f"({S.q(b)}, {S.q(r or '')})" for b, r, _ in derived.SITES)
_PROBES = ", ".join(f"({S.q(u)}, {s}, {S.q(x)})" for _, _, m in derived.SITES for u, (s, x) in m.items())
_ROBOTS = rf"""
sites(base_url, body) AS (VALUES {_SITE_BODIES}),
lines AS (SELECT base_url, unnest(string_split(replace(body, chr(13), chr(10)), chr(10))) AS l, generate_subscripts(string_split(replace(body, chr(13), chr(10)), chr(10)), 1) AS pos FROM sites),
named AS (SELECT base_url, pos, {S.trim("regexp_extract(l, '(?i)^\\s*sitemap\\s*:\\s*(.+)$', 1)")} AS s FROM lines WHERE regexp_matches(l, '(?i)^\s*sitemap\s*:\s*.+$')),
full_ AS (SELECT base_url, pos, {S.absolute("s", "rtrim(base_url, '/') || '/robots.txt'")} AS url FROM named WHERE s <> ''),
maps AS (SELECT base_url, url, min(pos) AS pos FROM full_ GROUP BY ALL)""".replace("\\\\s", "\\s")


@query(f"WITH {_ROBOTS} SELECT base_url, coalesce(string_agg(url, ' ' ORDER BY pos), '') AS sitemaps FROM sites LEFT JOIN maps USING (base_url) GROUP BY base_url")
def robots_sitemaps(spark, sf_dir):
    return sitechecks.robots(*derived.sites(spark)).select("base_url", F.array_join("sitemaps", " ").alias("sitemaps"))


@query(f"""WITH {_ROBOTS}, probes(url, status, body) AS (VALUES {_PROBES}),
    candidates AS (SELECT base_url, url, pos FROM maps UNION ALL SELECT base_url, rtrim(base_url, '/') || '/sitemap.xml', 1000 FROM sites UNION ALL SELECT base_url, rtrim(base_url, '/') || '/sitemap_index.xml', 1001 FROM sites),
    tried AS (SELECT base_url, c.url, min(pos) AS pos, any_value(coalesce(status, 0)) AS status FROM candidates c LEFT JOIN probes p ON p.url = c.url GROUP BY base_url, c.url)
    SELECT base_url, coalesce(first(url ORDER BY pos) FILTER (status = 200), '') AS sitemap_url, CAST(CASE WHEN bool_or(status = 200) THEN 200 ELSE last(status ORDER BY pos) END AS BIGINT) AS sitemap_status FROM tried GROUP BY base_url""")
def sitemap_choice(spark, sf_dir):
    return sitechecks.site_checks(*derived.sites(spark)).select("base_url", "sitemap_url", "sitemap_status")


@query(rf"""WITH {_ROBOTS}, probes(url, status, body) AS (VALUES {_PROBES}),
    candidates AS (SELECT base_url, url, pos FROM maps UNION ALL SELECT base_url, rtrim(base_url, '/') || '/sitemap.xml', 1000 FROM sites UNION ALL SELECT base_url, rtrim(base_url, '/') || '/sitemap_index.xml', 1001 FROM sites),
    chosen AS (SELECT base_url, first(p.body ORDER BY pos) FILTER (status = 200) AS x FROM candidates c LEFT JOIN probes p ON p.url = c.url GROUP BY base_url)
    SELECT base_url, CAST(CASE WHEN len(regexp_extract_all(x, '<[A-Za-z:]+(\s[^<>]*)?>')) = len(regexp_extract_all(x, '</[A-Za-z:]+>'))
        THEN len(regexp_extract_all(x, '<([A-Za-z]+:)?url[\s/>]')) ELSE 0 END AS BIGINT) AS sitemap_url_count FROM chosen""")
def sitemap_url_count(spark, sf_dir):
    """Counted by an XML parser, broken files included; the SQL knows a broken file by tags that don't pair."""
    return sitechecks.site_checks(*derived.sites(spark)).select("base_url", "sitemap_url_count")


_HOPS = ", ".join(f"({S.q(u)}, {h}, {S.q(r)}, {s}, {S.q(x)})" for u, h, r, s, x in derived.HOPS)


@query(f"""WITH hops(url, hop, request_url, status, location) AS (VALUES {_HOPS}), r AS (SELECT *, status BETWEEN 300 AND 399 AND location <> '' AS moved FROM hops)
    SELECT url, CAST(first(status ORDER BY hop) AS BIGINT) AS first_status, coalesce(first({S.resolve("location", "request_url")} ORDER BY hop) FILTER (moved), '') AS redirect_target,
        CASE WHEN count(*) FILTER (moved) > 0 AND last(status ORDER BY hop) NOT BETWEEN 300 AND 399 THEN last(request_url ORDER BY hop) ELSE '' END AS redirect_final_url, count(*) FILTER (moved) AS redirect_hops, count(*) FILTER (moved) >= 5 AS too_many FROM r GROUP BY url""")
def redirect_chain_fold(spark, sf_dir):
    return sitechecks.redirect_folds(derived.hops(spark))


_OCTETS = "list_transform(string_split(h, '.'), lambda x: TRY_CAST(x AS BIGINT))"


def _hex_spans() -> str:
    """Whether the hexadecimal digits `hex` of an address are within the private and reserved networks."""
    spans = ((n.network_address, n.broadcast_address) for n in map(ipaddress.IPv6Network, guard.IPV6))
    return " OR ".join(f"hex BETWEEN '{int(a):032x}' AND '{int(b):032x}'" for a, b in spans)


_SIDE = "CASE WHEN coalesce({0}, '') = '' THEN [] ELSE string_split({0}, ':') END"
_TAIL = r"^(.*:)(\d+)\.(\d+)\.(\d+)\.(\d+)$"
_PAIR = f"printf('%x', CAST(regexp_extract(x, '{_TAIL}', {{0}}) AS INT) * 256 + CAST(regexp_extract(x, '{_TAIL}', {{1}}) AS INT))"
_GUARD = rf"""WITH u AS (SELECT n, trim(u) AS raw, lower(regexp_extract(trim(u), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS h FROM (SELECT -1 - n AS n, u FROM {_values(derived.GUARDED, "u")} UNION ALL SELECT page_id, url FROM pages)),
    a AS (SELECT *, CASE WHEN starts_with(h, '[') THEN substr(h, 2, length(h) - 2) ELSE '' END AS x FROM u),
    s6 AS (SELECT *, string_split(CASE WHEN regexp_matches(x, '{_TAIL}') THEN regexp_extract(x, '{_TAIL}', 1) || {_PAIR.format(2, 3)} || ':' || {_PAIR.format(4, 5)} ELSE x END, '::') AS sides FROM a),
    g6 AS (SELECT *, {_SIDE.format("sides[1]")} AS head, {_SIDE.format("sides[2]")} AS tail FROM s6),
    f6 AS (SELECT *, 8 - len(head) - len(tail) AS missing, list_concat(head, list_transform(range(0, CASE WHEN len(sides) = 2 THEN greatest(8 - len(head) - len(tail), 0) ELSE 0 END), lambda i: '0'), tail) AS filled FROM g6),
    h6 AS (SELECT *, CASE WHEN x <> '' AND len(sides) <= 2 AND CASE WHEN len(sides) = 2 THEN missing >= 1 ELSE missing = 0 END AND len(list_filter(filled, lambda g: NOT regexp_matches(g, '^[0-9a-f]{{1,4}}$'))) = 0 THEN array_to_string(list_transform(filled, lambda g: lpad(g, 4, '0')), '') END AS hex FROM f6),
    f AS (SELECT *, regexp_matches(h, '^\d+\.\d+\.\d+\.\d+$') AS v4, {_OCTETS} AS o FROM h6),
    g AS (SELECT *, v4 AND (o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254)) OR coalesce({_hex_spans()}, false) AS private FROM f),
    e AS (SELECT n, raw, CASE WHEN raw = '' THEN {S.q(guard.REQUIRED)} WHEN NOT regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:[\x21-\x7E]+$') OR (s IN ('http', 'https') AND hex IS NULL AND NOT regexp_matches(h, '^[a-z0-9.-]+$')) THEN {S.q(guard.INVALID)}
        WHEN s NOT IN ('http', 'https') THEN {S.q(guard.BAD_SCHEME)} WHEN h = 'localhost' OR h LIKE '%.localhost' OR h LIKE '%.local' OR (hex IS NULL AND NOT contains(h, '.')) OR private THEN {S.q(guard.PRIVATE_NAME)}
        WHEN h = 'inside.example' THEN {S.q(guard.PRIVATE_ADDRESS)} ELSE '' END AS error FROM g)"""


def _candidates(spark, sf_dir):
    """n, base_url: GUARDED, numbered below 0, and the URLs of all pages."""
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("n"), F.col("url").alias("base_url"))
    return derived.literals(spark, derived.GUARDED, "base_url").select((-1 - F.col("n")).alias("n"), "base_url").unionByName(own)


def _dns(spark):
    return spark.createDataFrame(derived.DNS, "host string, ips array<string>")


@query(f"{_GUARD} SELECT n, error = '' AS ok, error, CASE WHEN error = '' THEN rtrim(raw, '/') ELSE '' END AS url FROM e")
def url_guard(spark, sf_dir):
    return guard.guarded(_candidates(spark, sf_dir), _dns(spark)).select("n", "ok", "error", "url")


@query(f"{_GUARD} SELECT n AS uid, rtrim(raw, '/') AS base_url FROM e WHERE error = '' UNION ALL SELECT uid, base_url FROM (WITH {S.REPORTS} SELECT * FROM reports)")
def insert_reports(spark, sf_dir):
    """All reports, and new ones of the URLs that the guard admits."""
    reports = derived.reports(spark, sf_dir)
    new = _candidates(spark, sf_dir).select(*(F.col("n").alias("uid") if f.name == "uid" else F.col("base_url") if f.name == "base_url" else F.lit(None).cast(f.dataType).alias(f.name) for f in reports.schema))
    return guard.inserted(reports, new, _dns(spark))[0].select("uid", "base_url")


# ---------------------------------------------------------------- scalar functions
@query("SELECT event_id, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;') AS escaped FROM events")
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.escape_html(F.col("props")).alias("escaped"))


_ERRORS = ["cURL error 28: Timed out", "SSL Connection Timeout", "The operation timed out", "Connection refused", ""]


@query(f"SELECT n, contains(lower(m), 'curl error 28') OR contains(lower(m), 'ssl connection timeout') OR contains(lower(m), 'operation timed out') AS retry FROM {_values(_ERRORS, 'm')}")
def fetch_retry(spark, sf_dir):
    return derived.literals(spark, _ERRORS, "m").select("n", T.is_timeout(F.col("m")).alias("retry"))


_HEADERS = ["Content-Type: text/html", "LOCATION:  /x ", "X-A: 1:2"]


@query(f"SELECT n, lower(trim(split_part(h, ':', 1))) AS name, trim(substr(h, instr(h, ':') + 1)) AS value FROM {_values(_HEADERS, 'h')}")
def header_lines(spark, sf_dir):
    one = derived.literals(spark, _HEADERS, "h").select("n", F.explode(T.parse_header_lines(F.array("h"))).alias("name", "values"))
    return one.select("n", "name", F.get("values", F.lit(0)).alias("value"))


@query(S.cross(f"SELECT page_id, {_counts('error')} AS errors, {_counts('notice')} AS notices, array_to_string(list_transform(issues, lambda x: x.type), ' | ') AS types, CAST(len(issues) AS BIGINT) AS n FROM final"))
def issues_json(spark, sf_dir):
    """Issues written to the JSON text of the page table, read back and counted."""
    rows = checked(spark, sf_dir).select("page_id", scoring.issues_from_json(F.to_json("issues")).alias("i"))
    i = F.col("i")
    return rows.select("page_id", scoring.severity_count(i, "error").cast("string").alias("errors"), scoring.severity_count(i, "notice").cast("string").alias("notices"), scoring.issue_types(i).alias("types"), F.size("i").alias("n"))


@query(S.reports(f"SELECT uid, CASE WHEN queued_at > 0 THEN queued_at ELSE {derived.NOW} END AS queued_at, CASE WHEN status = 2 THEN 'yes' ELSE 'no' END AS done FROM reports"))
def queue_time(spark, sf_dir):
    return derived.reports(spark, sf_dir).select("uid", scoring.queue_time(F.col("queued_at"), F.lit(derived.NOW)).alias("queued_at"), scoring.yes_no(F.col("status") == 2).alias("done"))


@query(S.cross("SELECT report, count(*) AS n FROM final WHERE report NOT IN (2, 5) GROUP BY report"))
def clear_report_stored(spark, sf_dir):
    """Pages left when those of reports 2 and 5 are cleared for another crawl."""
    gone = spark.createDataFrame([(2,), (5,)], "uid bigint")
    return R.without_reports(stored(spark, sf_dir), gone, "report").groupBy("report").agg(F.count("*").alias("n"))


@query(S.cross("SELECT report, max(page_id) AS progress_pages, arg_max(url, page_id) AS last_crawled_url FROM final GROUP BY report"))
def crawl_progress(spark, sf_dir):
    return R.progress(stored(spark, sf_dir).withColumn("crawl_order", F.col("page_id")))


# ---------------------------------------------------------------- crawl
def _bases(spark, sf_dir):
    return crawl_view.read(spark, sf_dir).groupBy("report").agg(F.min_by("url", "page_id").alias("base_url")).withColumn("max_pages", F.lit(12))


_LINKED = f"list_filter(list_transform(list_concat(coalesce(CASE WHEN kind = 'html' THEN internal_all END, []), CASE WHEN kind = 'redirect' THEN ['http://site' || report || '.example.com/p/' || (page_id + 7 * redirect_hops)] ELSE [] END), lambda x: {S.normalized('x')}), lambda x: x IS NOT NULL)"


@query(
    S.cross(f"""SELECT report, CAST(step AS BIGINT) AS crawl_order, b.url, CAST(coalesce(CASE WHEN a.kind = 'failed' THEN 0 ELSE a.status_code END, 404) AS BIGINT) AS status_code, coalesce(a.page_score, 38) AS page_score FROM (
        WITH RECURSIVE next AS (SELECT report, {S.normalized("url")} AS url, {_LINKED} AS links FROM audited),
        walk AS (
            SELECT report, 1 AS step, [{S.normalized("base")}] AS queue FROM (SELECT report, arg_min(url, page_id) AS base FROM audited GROUP BY report)
            UNION ALL
            SELECT w.report, step + 1, list_concat(queue, list_filter(coalesce(n.links, []), lambda x, i: NOT list_contains(queue, x) AND list_position(n.links, x) = i)) FROM walk w LEFT JOIN next n ON n.report = w.report AND n.url = queue[step] WHERE step <= 12 AND step <= len(queue)
        ) SELECT report, step, queue[step] AS url FROM walk WHERE step <= 12 AND step <= len(queue)) b LEFT JOIN audited a USING (report, url)""")
)
def frontier_bfs(spark, sf_dir):
    """Crawl order of each report's site map from its first page, within a budget of 12 pages."""
    found = crawl.crawl(_bases(spark, sf_dir), crawl.from_site_map(crawl_view.read(spark, sf_dir)))
    return found.select("report", "crawl_order", "url", "status_code", "page_score")
