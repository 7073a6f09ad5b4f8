"""DuckDB SQL of the audit, as chains of common table expressions over the test tables."""

from __future__ import annotations

from auditloom.functions.text import NAMED
from auditloom.functions.urls import PARTS, SKIPPED
from auditloom.sources.crawl_view import ODD


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Columns ref_names and ref_chars, which decode() reads.
REFS = f"refs AS (SELECT [{', '.join(q(f'&{n};') for n in NAMED)}] AS ref_names, [{', '.join(q(chr(p)) for p in NAMED.values())}] AS ref_chars)"
_REFERENCE = q("&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]*;")


def decode(x: str) -> str:
    number = "CAST(CASE WHEN lower(p[2][3]) = 'x' THEN '0x' || regexp_extract(p[2], '[0-9A-Fa-f]+') ELSE regexp_extract(p[2], '[0-9]+') END AS BIGINT)"
    char = f"CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) ELSE '' END"
    one = f"CASE WHEN p[2] IS NULL THEN '' WHEN starts_with(p[2], '&#') THEN {char} ELSE coalesce(ref_chars[list_position(ref_names, p[2])], p[2]) END"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(list_zip(string_split_regex({x}, {_REFERENCE}), regexp_extract_all({x}, {_REFERENCE})), lambda p: p[1] || {one}), '') ELSE {x} END"


def trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(13))"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, {q(PARTS)}, {n})"


def resolve(rel: str, base: str) -> str:
    scheme = f"coalesce(nullif({part(base, 1)}, ''), 'https')"
    site = f"{scheme} || '://' || {part(base, 2)}"
    folder = rf"rtrim(regexp_replace({part(base, 3)}, '/[^/]*/?\z', ''), '/')"
    return f"CASE WHEN starts_with({rel}, '//') THEN {scheme} || ':' || {rel} WHEN starts_with({rel}, '/') THEN {site} || {rel} ELSE {site} || {folder} || '/' || {rel} END"


def absolute(u: str, base: str) -> str:
    return f"CASE WHEN starts_with({u}, 'http://') OR starts_with({u}, 'https://') THEN {u} ELSE {resolve(u, base)} END"


def normalized(full: str) -> str:
    """Of an absolute URL."""
    return f"CASE WHEN {part(full, 2)} <> '' THEN {part(full, 1)} || '://' || {part(full, 2)} || coalesce(nullif(rtrim({part(full, 3)}, '/'), ''), '/') END"


def bare(u: str) -> str:
    return trim(f"regexp_replace({u}, '#.*$', '')")


def normalize(u: str, base: str) -> str:
    return f"CASE WHEN {bare(u)} = '' THEN NULL ELSE {normalized('(' + absolute(bare(u), base) + ')')} END"


INSIDE = r"""[^>=]*(?:=(?:\s*"[^"]*"|\s*'[^']*')?[^>=]*)*"""
ANY_TAG = rf"(?is)</?[a-z]{INSIDE}>|<[!?][^>]*>"
VALUE = r""""[^"]*"|'[^']*'|[^\s"'>][^\s>]*"""
BEFORE = rf"(?is)^<[^\s/>]+(?:[\s/]+[^\s/>=]+(?:\s*=\s*(?:{VALUE}))?)*?[\s/]+"
UNQUOTE = r"""(?s)^(?:"(.*)"|'(.*)')$"""


def attribute(t: str, name: str) -> str:
    raw = f"regexp_extract({t}, {q(rf'{BEFORE}{name}\s*=\s*({VALUE})')}, 1)"
    return decode(rf"(regexp_replace({raw}, {q(UNQUOTE)}, '\1\2'))")


def has_attribute(t: str, name: str) -> str:
    return f"regexp_matches({t}, {q(rf'{BEFORE}{name}[\s/=>]')})"


def tags(name: str) -> str:
    return f"list_filter(regexp_extract_all(clean, {q(rf'(?is)<[a-z]{INSIDE}>')}), lambda x: regexp_matches(x, '(?i)^<{name}[\\s/>]'))"


def first_content(list_: str, key: str, value: str, wanted: str) -> str:
    t = "x"
    return f"list_transform(list_filter({list_}, lambda {t}: {attribute(t, key)} = {q(value)} AND {has_attribute(t, wanted)}), lambda {t}: {attribute(t, wanted)})[1]"


def element_text(name: str) -> str:
    return trim(decode(f"regexp_replace(regexp_extract(clean, {q(rf'(?is)<{name}(?:[\s/]{INSIDE})?>(.*?)</{name}\s*>')}, 1), {q(ANY_TAG)}, '', 'g')"))


_PLAIN = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
#: The text of a page's body.
BODY = decode(rf"""regexp_replace(CASE WHEN regexp_matches({_PLAIN}, '(?i)<body[\s/>]') THEN regexp_extract({_PLAIN}, {q(rf'(?is)<body(?:[\s/]{INSIDE})?>(.*?)(?:</body\s*>|\z)')}, 1)
    ELSE regexp_replace({_PLAIN}, '(?is)<head[\s>].*?</head\s*>|<title\b.*?</title\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') END, {q(ANY_TAG)}, '', 'g')""")


SKIP_LIST = ", ".join(q(e) for e in SKIPPED)


def skipped(u: str) -> str:
    return rf"regexp_extract(lower({part(u, 3)}), '\.([^./]*)\z', 1) IN ({SKIP_LIST})"


CRAWL = rf"""
crawl AS (
    SELECT i % 7 + 1 AS report, i AS page_id, 'http://site' || (i % 7 + 1) || '.example.com/p/' || i AS url,
        CAST(CASE i % 20 WHEN 3 THEN 404 WHEN 7 THEN 500 WHEN 11 THEN 301 WHEN 13 THEN 0 ELSE 200 END AS BIGINT) AS status_code,
        CASE i % 11 WHEN 5 THEN 'application/pdf' WHEN 6 THEN '' ELSE 'Text/HTML; charset=UTF-8' END AS content_type_header,
        CASE WHEN i % 20 = 11 THEN i % 3 + 1 ELSE 0 END AS redirect_hops,
        i * 37 % 900 AS load_time,
        CASE WHEN i % 20 = 13 THEN 'cURL error 28: Operation timed out' ELSE '' END AS fetch_error,
        replace(replace(h1, '</head>',
            CASE WHEN i % 4 <> 0 THEN '<meta name="description" content="' || trim(substring(repeat('lorem ipsum ', 20), 1, CAST(i % 5 * 45 AS INTEGER))) || '">' ELSE '' END
            || CASE WHEN i % 3 <> 0 THEN '<link rel="canonical" href="http://site' || (i % 7 + 1) || '.example.com/p/' || i || '">' ELSE '' END
            || CASE WHEN i % 10 = 1 THEN '<meta name="robots" content="NOINDEX,nofollow">' ELSE '' END
            || CASE WHEN i % 2 = 0 THEN '<meta property="og:title" content="t">' ELSE '' END
            || CASE WHEN i % 6 = 0 THEN '<meta property="og:description" content="">' ELSE '' END || '</head>'), '</article>',
            CASE WHEN i % 8 = 2 THEN '<h1>Second</h1>' ELSE '' END
            || CASE i % 4 WHEN 1 THEN '<img src="a.png">' WHEN 2 THEN '<img src="a.png" alt="a"><img src="b.png" alt=" ">' WHEN 3 THEN '<img src="a.png" alt="a">' ELSE '' END
            || '<a href="/p/' || (i + 7) || '">x</a><a href="/p/' || (i + 14) || '?x=1#f">x</a><a href="/p/' || (i + 21) || '/">x</a><a href="/p/' || (i + 28) || '">x</a><a href="/p/' || (i + 42)
            || '">x</a><a href="https://cdn.example.org/x">x</a><a href="mailto:a@b.c">x</a></article>') AS html
    FROM (
        SELECT i, CASE WHEN i % 8 = 5 THEN replace(replace(t, '<h1>', '<h3>'), '</h1>', '</h3>') ELSE t END AS h1 FROM (
            SELECT page_id AS i, CASE i % 13 WHEN 4 THEN regexp_replace(html, '<title>[^<]*</title>', '<title></title>') WHEN 6 THEN replace(html, '</title>', repeat(' x', 40) || '</title>') ELSE html END AS t FROM pages))
)"""

FACTS = rf"""
{REFS}, typed AS (
    SELECT *, lower({trim("split_part(content_type_header, ';', 1)")}) AS ctype FROM crawl
), kinds AS (
    SELECT *, CASE WHEN fetch_error <> '' THEN 'failed' WHEN redirect_hops > 0 THEN 'redirect'
        WHEN CASE WHEN ctype = '' THEN NOT {skipped("url")} ELSE contains(ctype, 'text/html') OR contains(ctype, 'application/xhtml+xml') END THEN 'html' ELSE 'resource' END AS kind FROM typed
), texts AS (
    SELECT * EXCLUDE (html), CASE WHEN kind = 'html' THEN html ELSE '' END AS html,
        CASE WHEN kind = 'html' THEN regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') ELSE '' END AS clean FROM kinds, refs
), cut AS (
    SELECT *, {tags("meta")} AS metas, {tags("link")} AS link_tags, {tags("img")} AS imgs,
        list_transform(list_filter({tags("a")}, lambda x: {has_attribute("x", "href")}), lambda x: {trim(attribute("x", "href"))}) AS hrefs, {BODY} AS body FROM texts
), linked AS (
    SELECT *, list_transform(list_filter(hrefs, lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, 'mailto:') AND NOT starts_with(x, 'tel:') AND NOT starts_with(x, 'javascript:')), lambda x: {absolute("x", "url")}) AS urls FROM cut
), facts AS (
    SELECT report, page_id, url, status_code, kind, ctype, redirect_hops, load_time, fetch_error,
        {element_text("title")} AS page_title, {element_text("h1")} AS h1_full,
        CAST(len({tags("h1")}) AS BIGINT) AS h1_count, CAST(len({tags("h2")}) AS BIGINT) AS h2_count,
        {trim("coalesce(" + first_content("metas", "name", "description", "content") + ", '')")} AS meta_description,
        {trim("coalesce(" + first_content("link_tags", "rel", "canonical", "href") + ", '')")} AS canonical_url,
        lower(coalesce({first_content("metas", "name", "robots", "content")}, '')) AS robots,
        {first_content("metas", "property", "og:title", "content")} IS NOT NULL AS has_og_title,
        {first_content("metas", "property", "og:description", "content")} IS NOT NULL AS has_og_description,
        CAST(len(imgs) AS BIGINT) AS images_total, CAST(len(list_filter(imgs, lambda x: {trim(attribute("x", "alt"))} = '')) AS BIGINT) AS images_missing_alt,
        CAST(len(regexp_extract_all(regexp_replace(regexp_replace(body, '(?s)<[^\s>][^>]*(?:>|\z)', '', 'g'), '^[''-]+|-\z', '', 'g'), '[A-Za-z''-]+')) AS BIGINT) AS word_count,
        list_filter(urls, lambda x: {part("x", 2)} = {part("url", 2)}) AS internal_all, len(urls) AS n_urls FROM linked
), rich AS (
    SELECT *, CAST(length(page_title) AS BIGINT) AS title_length, CAST(length(meta_description) AS BIGINT) AS meta_description_length, substring(h1_full, 1, 200) AS h1_text,
        contains(robots, 'noindex') AS robots_noindex, contains(robots, 'nofollow') AS robots_nofollow,
        CAST(len(internal_all) AS BIGINT) AS links_internal, CAST(n_urls - len(internal_all) AS BIGINT) AS links_external FROM facts
)"""


def issue(kind: str, severity: str, fires: str, text: str) -> str:
    return f"CASE WHEN {fires} THEN {{'type': '{kind}', 'severity': '{severity}', 'message': {text}}} END"


_HTML_ISSUES = [
    issue("http_error", "error", "status_code >= 400", "'HTTP error: ' || status_code"),
    issue("missing_title", "error", "title_length = 0", "'Page title is missing'"),
    issue("title_too_long", "warning", "title_length > 60", "'Title is too long (' || title_length || ' chars, max 60 recommended)'"),
    issue("title_too_short", "warning", "title_length BETWEEN 1 AND 9", "'Title is too short (' || title_length || ' chars, min 10 recommended)'"),
    issue("missing_meta_description", "warning", "meta_description_length = 0", "'Meta description is missing'"),
    issue("meta_description_too_long", "notice", "meta_description_length > 160", "'Meta description is too long (' || meta_description_length || ' chars, max 160 recommended)'"),
    issue("meta_description_too_short", "notice", "meta_description_length BETWEEN 1 AND 49", "'Meta description is too short (' || meta_description_length || ' chars, min 50 recommended)'"),
    issue("missing_h1", "error", "h1_count = 0", "'Page has no H1 heading'"),
    issue("multiple_h1", "warning", "h1_count > 1", "'Page has ' || h1_count || ' H1 headings (exactly 1 recommended)'"),
    issue("missing_canonical", "notice", "canonical_url = ''", "'No canonical URL defined'"),
    issue("noindex", "warning", "robots_noindex", "'Page has noindex directive - it will not be indexed by search engines'"),
    issue("images_missing_alt", "warning", "images_missing_alt > 0", "images_missing_alt || ' image(s) missing alt attributes'"),
    issue("thin_content", "warning", "word_count < 300 AND status_code < 400", "'Thin content: ' || word_count || ' words (min 300 recommended)'"),
    issue("missing_og_title", "notice", "NOT has_og_title", "'Missing Open Graph og:title meta tag'"),
    issue("missing_og_description", "notice", "NOT has_og_description", "'Missing Open Graph og:description meta tag'"),
]
_RESOURCE_ISSUES = [
    issue("http_error", "error", "status_code >= 400", "'HTTP error: ' || status_code"),
    issue("non_html_resource", "notice", "true", "'Skipped HTML checks for non-HTML resource (' || coalesce(nullif(ctype, ''), 'unknown content type') || ')'"),
]


def score(issues: str) -> str:
    return f"CAST(greatest(0, 100 - coalesce(list_sum(list_transform({issues}, lambda x: CASE x.severity WHEN 'error' THEN 15 WHEN 'warning' THEN 8 WHEN 'notice' THEN 3 ELSE 0 END)), 0)) AS BIGINT)"


PAGES = f"""
raised AS (
    SELECT *, list_filter(CASE kind
        WHEN 'failed' THEN [{issue("fetch_error", "error", "true", "'Failed to fetch page: ' || fetch_error")}]
        WHEN 'redirect' THEN [{issue("redirect", "notice", "true", "CASE WHEN redirect_hops = 1 THEN 'URL responded with a redirect' ELSE 'URL redirected ' || redirect_hops || ' times before reaching the final target' END")}]
        WHEN 'resource' THEN [{", ".join(_RESOURCE_ISSUES)}]
        ELSE [{", ".join(_HTML_ISSUES)}] END, lambda x: x IS NOT NULL) AS issues FROM rich
), audited AS (
    SELECT * EXCLUDE (issues), issues, CASE kind WHEN 'failed' THEN 0 WHEN 'redirect' THEN 100 WHEN 'resource' THEN CASE WHEN status_code >= 400 THEN 0 ELSE 100 END ELSE {score("issues")} END AS page_score,
        CASE WHEN kind = 'failed' THEN 'resource' ELSE kind END AS page_type, CASE WHEN kind = 'failed' THEN '' ELSE ctype END AS content_type FROM raised
)"""

CROSS = f"""
dup_titles AS (
    SELECT report, lower({trim("page_title")}) AS key, count(*) AS n FROM audited WHERE page_type = 'html' AND {trim("page_title")} <> '' GROUP BY ALL HAVING count(*) >= 2
), dup_metas AS (
    SELECT report, lower({trim("meta_description")}) AS key, count(*) AS n FROM audited WHERE page_type = 'html' AND {trim("meta_description")} <> '' GROUP BY ALL HAVING count(*) >= 2
), known AS (
    SELECT *, row_number() OVER (PARTITION BY report, key ORDER BY page_score DESC, page_id DESC) AS rn FROM (SELECT *, {normalized("url")} AS key FROM audited)
), edges AS (
    SELECT report, page_id, CAST(pos AS BIGINT) AS pos, {normalized("link")} AS key FROM (
        SELECT report, page_id, unnest(list_distinct_ordered) AS link, generate_subscripts(list_distinct_ordered, 1) - 1 AS pos FROM (
            SELECT report, page_id, list_filter(internal_all, lambda x, i: list_position(internal_all, x) = i) AS list_distinct_ordered FROM known WHERE rn = 1 AND page_type = 'html'))
), broken AS (
    SELECT e.report, e.page_id, e.pos, k.url FROM edges e JOIN known k ON k.rn = 1 AND k.report = e.report AND k.key = e.key AND (k.status_code >= 400 OR k.status_code = 0)
), firsts AS (
    SELECT report, page_id, url, min(pos) AS pos FROM broken GROUP BY ALL
), broken_pages AS (
    SELECT report, page_id, count(*) AS n, string_agg(url, ', ' ORDER BY pos) FILTER (rn <= 3) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY report, page_id ORDER BY pos) AS rn FROM firsts) GROUP BY ALL
), messages AS (
    SELECT report, page_id, n, CASE WHEN n = 1 THEN 'Page contains 1 broken internal link' ELSE 'Page contains ' || n || ' broken internal links' END || ': ' || shown || CASE WHEN n > 3 THEN ' (+' || (n - 3) || ' more)' ELSE '' END AS message FROM broken_pages
), joined AS (
    SELECT a.* EXCLUDE (issues, page_score), a.page_score AS old_score,
        t.n IS NOT NULL OR m.n IS NOT NULL OR b.n IS NOT NULL AS touched,
        list_concat(a.issues,
            CASE WHEN t.n IS NOT NULL THEN [{{'type': 'duplicate_title', 'severity': 'warning', 'message': 'Page title is duplicated on multiple crawled pages'}}] ELSE [] END,
            CASE WHEN m.n IS NOT NULL THEN [{{'type': 'duplicate_meta_description', 'severity': 'notice', 'message': 'Meta description is duplicated on multiple crawled pages'}}] ELSE [] END,
            CASE WHEN b.n IS NOT NULL THEN [{{'type': 'broken_internal_links', 'severity': 'error', 'message': b.message}}] ELSE [] END) AS issues
    FROM audited a
    LEFT JOIN dup_titles t ON a.page_type = 'html' AND t.report = a.report AND t.key = lower({trim("a.page_title")})
    LEFT JOIN dup_metas m ON a.page_type = 'html' AND m.report = a.report AND m.key = lower({trim("a.meta_description")})
    LEFT JOIN messages b ON b.report = a.report AND b.page_id = a.page_id
), final AS (
    SELECT *, CASE WHEN touched THEN {score("issues")} ELSE old_score END AS page_score FROM joined
), issue_rows AS (
    SELECT report, page_id, page_score, generate_subscripts(issues, 1) - 1 AS pos, unnest(issues) AS i FROM final
)"""

REPORTS = """
reports AS (
    SELECT o_orderkey AS uid, epoch(o_orderdate)::BIGINT + o_orderkey % 97 AS crdate, o_orderkey % 13 = 0 AS deleted, 'Report ' || o_orderpriority || ' ' || o_orderkey AS title, 'https://site' || o_custkey % 50 || '.example.com' AS base_url,
        o_orderkey % 5 AS status, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey % 60 END AS pages_crawled, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey % 60 END AS progress_pages, o_custkey % 230 - 5 AS max_pages,
        o_orderkey % 101 AS overall_score, CASE WHEN o_orderkey % 5 = 3 THEN 'timeout' ELSE '' END AS error_message, epoch(o_orderdate)::BIGINT AS queued_at,
        CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1700000000 - o_orderkey % 60 END AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN 'https://a/b' ELSE ' ' END AS last_crawled_url FROM orders
)"""


def odd(select: str) -> str:
    """Over the crawl with odd markup in each page."""
    cases = " ".join(f"WHEN {i} THEN replace(html, {q(a)}, {q(b)})" for i, (a, b) in enumerate(ODD))
    return f"WITH {CRAWL.replace('crawl AS', 'plain AS', 1)}, crawl AS (SELECT * REPLACE (CASE page_id % {len(ODD)} {cases} END AS html) FROM plain), {FACTS} {select}"


def audit(select: str) -> str:
    return f"WITH {CRAWL}, {FACTS}, {PAGES} {select}"


def cross(select: str) -> str:
    return f"WITH {CRAWL}, {FACTS}, {PAGES}, {CROSS} {select}"


def reports(select: str) -> str:
    return f"WITH {REPORTS} {select}"
