"""Main text of web pages by site style trees.

Pages are read as a stream of tags into blocks of text, each with its path of block elements (tag, class, id). The
pages of a host are merged by path into its tree, whose branches are judged by two entropies:

- Content. A text that n of the m pages with its path have there has entropy log n / log m; one less that is its
  novelty. A branch's content importance is the share of its characters that are novel and no link text, and its mass is
  the number of such characters on a page.
- Presentation. An element's importance is the entropy, in units of log m, of the sequences of child elements that its m
  pages show. Where it is low, pages fill the same slots: the element is layout. Where it is high, content flows.

A branch's composite importance weighs both. A branch below `threshold` falls wherever it is, since the host repeats it
or links from it. A slot of a layout falls if its mass is below `slot_share` of that of the best slot beside it; headings,
paragraphs and the like belong to what is beside them and stay, as do all slots within an article that the page marks.
That decides on hosts of `min_pages` different pages or more. A path seen on fewer pages isn't judged; so on smaller hosts
names tell: what HTML itself calls menus, footers, asides, forms and the like, by tag, role, class or id, falls, and where
a page marks its article, only what is inside is text. Ids of headings, and of running text in an article, are anchors and
name nothing; there a class has to be such a name as a whole. Exact copies of a page count once in the tree, so that
mirrored articles aren't mistaken for boilerplate.

Edge cases: null html is empty and gives an empty text; a null url has the empty host; broken markup is read as
browsers do (a new paragraph ends the open one, a head ends where something stands that can't be in it, stray ends are skipped); extra columns are ignored; repeated rows give
repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import rows_to_batch, staged

#: HTML elements by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video dialog menu title xmp noembed noframes".split())
NO_TEXT = frozenset("head script style noscript template button select textarea iframe object svg canvas audio video title xmp noembed noframes".split())
ARTICLE = frozenset("article main".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that end an open one of these when they begin, within these bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOUNDS = frozenset("table td th article main section div body html ul ol dl aside nav footer header form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that name what isn't part of an article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|sidebars?|side|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|pagination|pager|search|toolbar|skip|disclaimer|copyright)(?:$|[\s_-])",
    re.I,
)
#: Elements of running text, whose ids are anchors made of their words, and elements that may stand in a head.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd td th blockquote pre figure figcaption".split())
RUNNING = INLINE | TEXTUAL | {"section"}
IN_HEAD = frozenset("base link meta title style script noscript template".split())
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar|site-header|page-header)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Element:
    __slots__ = ("dropped", "in_article", "inline", "linked", "path", "tag")

    def __init__(self, tag: str, path: str, dropped: bool, in_article: bool, inline: bool, linked: bool):
        self.tag, self.path, self.dropped, self.in_article, self.inline, self.linked = tag, path, dropped, in_article, inline, linked


class Block:
    __slots__ = ("dropped", "in_article", "links", "path", "text")

    def __init__(self, path: str, text: str, dropped: bool, in_article: bool, links: int):
        self.path, self.text, self.dropped, self.in_article, self.links = path, text, dropped, in_article, links


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def is_aside(tag: str, raw: str, in_article: bool, by_name: bool = True) -> tuple[bool, str]:
    """(whether the element is named as no part of an article, or is no text; the label that its path shows)."""
    if tag in (DROPPED if by_name else NO_TEXT) or by_name and tag == "header" and not in_article:
        return True, tag
    if not raw or "=" not in raw and "hidden" not in raw:
        return False, tag
    own = attributes(raw)
    named = f"{own.get('class', '')} {own.get('id', '')}".strip()
    label = f"{tag}.{re.sub(r'[0-9]+', '0', ' '.join(named.split()))}" if named else tag
    if len(label) > 80:
        label = f"{label[:80]}~{xxhash.xxh64_hexdigest(label.encode('utf-8', 'surrogatepass'))}"
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw) is not None or re.search(r"display\s*:\s*none", own.get("style", "")) is not None
    if tag in ("body", "html"):
        return False, label
    if not by_name:
        return hidden, label
    if tag in HEADINGS or in_article and tag in RUNNING:
        by_name = any(NAMES.fullmatch(x) for x in own.get("class", "").split())
    elif in_article:
        by_name = bool(NAMES.search(own.get("class", ""))) or bool(NAMES.fullmatch(own.get("id", "")))
    else:
        by_name = bool(NAMES.search(named))
    return hidden or own.get("role", "").lower() in ROLES or by_name or (not in_article and bool(PAGE_HEADER.search(named))), label


def parse(page: str | None, by_name: bool = True) -> tuple[list[Block], dict[str, list[str]]]:
    """(blocks with text in page order, child labels of the elements at each path)."""
    page = page or ""
    blocks: list[Block] = []
    shown: dict[str, list[str]] = {}
    stack = [Element("", "", False, False, False, False)]
    block = stack[0]  # the innermost element that isn't inline
    texts: list[str] = []
    links = 0  # characters of texts that are link text
    hidden = False  # an inline element that is dropped is open

    def flush() -> None:
        nonlocal links
        if texts:
            text = "".join(texts)
            texts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append(Block(block.path, text, block.dropped, block.in_article, min(links, len(text))))
        links = 0

    def settle() -> None:
        nonlocal block, hidden
        flush()
        block = next(e for e in reversed(stack) if not e.inline)
        hidden = stack[-1].dropped and not block.dropped

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if stack[-1].tag == "head" and page[at : m.start()].strip():
            stack.pop()
            settle()
        if m.start() > at and not hidden:
            texts.append(page[at : m.start()])
            if stack[-1].linked:
                links += len(texts[-1].strip())
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(not e.inline for e in stack[i:]):
                        flush()
                        del stack[i:]
                        settle()
                    else:
                        del stack[i:]
                        hidden = stack[-1].dropped and not block.dropped
                    break
                if tag in INLINE and not stack[i].inline:
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        raw = m[3] or m[6] or ""
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            flush()
            stack.pop()
            settle()
        if tag in VOID:
            if tag in INLINE:
                if tag == "br":
                    texts.append(" ")
            else:
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            closing, bounds = ({"p"}, BOUNDS) if tag in ENDS_P else IMPLIED.get(tag, ((), ()))
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closing:
                        del stack[i:]
                        break
                    if stack[i].tag in bounds:
                        break
        top = stack[-1]
        aside, label = is_aside(tag, raw, top.in_article, by_name)
        if inline:
            stack.append(Element(tag, top.path, top.dropped or aside, top.in_article, True, top.linked or tag == "a"))
            hidden = stack[-1].dropped and not block.dropped
        else:
            parent = next(e for e in reversed(stack) if not e.inline)
            shown.setdefault(parent.path, []).append(label)
            stack.append(Element(tag, f"{parent.path}/{label}", top.dropped or aside, top.in_article or tag in ARTICLE, False, top.linked))
            settle()
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
            settle()
    if not hidden and at < len(page):
        texts.append(page[at:])
    flush()
    return blocks, shown


def ancestors(path: str) -> list[str]:
    return [path[:i] for i in range(1, len(path)) if path[i] == "/"] + [path]


_SEEN = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("value", pa.int64()), ("page", pa.int64()), ("chars", pa.int32()), ("links", pa.int32())])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def observed(pages: DataFrame, by_name: bool = True) -> DataFrame:
    """host, path, kind, value, page, chars, links: what each distinct page shows at each path.

    kind 0: a text, with its characters and those of links in it; 1: the sequence of children. value and page are hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)
        for batch in batches:
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                blocks, shown = parse(page, by_name)
                key = digest(page or "")
                seen = {(b.path, 0, digest(b.text)): (len(b.text), b.links) for b in blocks}
                seen |= {(path, 1, digest(" ".join(labels))): (0, 0) for path, labels in shown.items()}
                rows += [(host, *x, key, *size) for x, size in seen.items()]
            yield rows_to_batch(rows, _SEEN)

    return pages.mapInArrow(run, "host string, path string, kind int, value bigint, page bigint, chars int, links int")


def importance(seen: DataFrame, own_weight: float = 0.3) -> DataFrame:
    """host, path, m (pages), content, shape, mass, composite of every branch with text below it on two pages or more.

    shape is null for branches without child elements; their composite is their content. All sums are combined before
    they are shuffled, so a host with most of the pages is no hot spot.
    """
    counts = seen.dropDuplicates(["host", "path", "kind", "value", "page"]).groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    # Pages that have the path: each page shows one sequence of children, but any number of texts.
    pages = seen.select("host", "path", "kind", "page").distinct().groupBy("host", "path", "kind").agg(F.count("*").alias("m"))
    n_log_n, free = F.col("n") * F.log("n"), F.col("chars") - F.col("links")
    sums = counts.groupBy("host", "path", "kind").agg(F.sum(n_log_n).alias("bits"), F.sum(F.col("n") * F.col("chars")).alias("all"), F.sum(F.col("n") * free).alias("free"), F.sum(n_log_n * free).alias("known"))
    merged = sums.join(pages, ["host", "path", "kind"]).where("m > 1")
    texts = merged.where("kind = 0").select("host", "path", "m", "all", (F.col("free") - F.col("known") / F.log("m")).alias("novel"))
    shape = merged.where("kind = 1").select("host", "path", F.col("m").alias("shown"), (1 - F.col("bits") / F.col("m") / F.log("m")).alias("shape"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = texts.where(F.size(parts) > 1).select("host", F.explode(up).alias("path"), "m", "all", "novel")
    below = below.groupBy("host", "path").agg(F.max("m").alias("m"), F.sum("all").alias("all"), F.sum("novel").alias("novel"))
    both = below.join(shape, ["host", "path"], "left").withColumn("m", F.greatest("m", F.coalesce("shown", "m")))
    content = F.col("novel") / F.greatest(F.col("all"), F.lit(1))
    return both.select("host", "path", "m", content.alias("content"), "shape", (F.col("novel") / F.col("m")).alias("mass"), F.coalesce(own_weight * F.col("shape") + (1 - own_weight) * content, content).alias("composite"))


def unimportant(seen: DataFrame, threshold: float = 0.3, slot_share: float = 0.1, layout_shape: float = 0.15, own_weight: float = 0.3, min_pages: int = 8, by_name: bool = True) -> DataFrame:
    """host, paths (array): the branches of each host, seen on min_pages pages or more, whose composite importance is below the
    threshold, and the slots whose mass is below slot_share of that of the best slot of their layout."""
    tree = staged(importance(seen, own_weight), "tree").withColumn("parent", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    tag = F.regexp_extract("path", r"/([^/.]*)[^/]*$", 1)
    layouts = tree.where((F.col("m") >= min_pages) & (F.col("shape") < layout_shape)).select("host", F.col("path").alias("parent"))
    best = tree.groupBy("host", "parent").agg(F.max("mass").alias("best")).join(layouts, ["host", "parent"], "left_semi")
    judged = tree.where(F.col("m") >= min_pages).join(best, ["host", "parent"], "left")
    slot = ~tag.isin(*sorted(TEXTUAL)) & (F.col("mass") < slot_share * F.col("best"))
    if by_name:
        slot = slot & ~F.col("parent").rlike(rf"/(?:{'|'.join(sorted(ARTICLE))})(?:[./]|$)")
    # A container's text is told from boilerplate within it, unless all its pages say the same.
    low = F.when(tag.isin("html", "body", *sorted(ARTICLE)), F.col("content") < threshold / 3).otherwise(F.col("composite") < threshold)
    return judged.where(low | F.coalesce(slot, F.lit(False))).groupBy("host").agg(F.collect_list("path").alias("paths"))


def tag_of(path: str) -> str:
    return path.rsplit("/", 1)[1].split(".", 1)[0]


def container_at(up: list[str], articles: bool) -> int:
    """Of the paths down to an element: the place of its container, the outermost marked article, else the body; -1 if there's none."""
    top = next((i for i, p in enumerate(up) if tag_of(p) in ARTICLE), None) if articles else None
    return max((i for i, p in enumerate(up) if tag_of(p) in ("html", "body")), default=-1) if top is None else top


def is_pruned(path: str, pruned: frozenset[str], by_name: bool = True) -> bool:
    """Whether a branch on the way from the container (see container_at) down to the path is unimportant.

    In a container that is itself unimportant, all pages of the host say the same, and nothing tells text from boilerplate.
    """
    up = ancestors(path)
    top = container_at(up, by_name)
    return (top < 0 or up[top] not in pruned) and any(p in pruned for p in up[top + 1 :])


def is_undecided(path: str, pruned: frozenset[str]) -> bool:
    """Whether the path's container is unimportant, so that the tree says nothing about the path."""
    up = ancestors(path)
    top = container_at(up, True)
    return top >= 0 and up[top] in pruned


def main_text(page: str | None, pruned: frozenset[str], by_name: bool = True, articles: bool | None = None) -> str:
    """articles: whether a marked article is the container within which branches fall; by default as by_name. With it, and without
    names, names decide after all on a page whose container is unimportant."""
    blocks, _ = parse(page, by_name)
    paths = {b.path for b in blocks}
    if articles and not by_name and any(is_undecided(p, pruned) for p in paths):
        return main_text(page, pruned)
    fallen = {path for path in paths if is_pruned(path, pruned, by_name if articles is None else articles)} if pruned else pruned
    kept = [b for b in blocks if not b.dropped and b.path not in fallen]
    inside = [b for b in kept if b.in_article] if by_name else []
    return "\n".join(b.text for b in inside or kept)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extracted(pages: DataFrame, threshold: float = 0.3, min_pages: int = 8, by_name: bool | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of pages (page_id, url, html).

    The tree decides on hosts of min_pages different pages or more; on smaller ones, which it can't judge, names of tags, classes
    and roles do. On large hosts nothing falls by its name; just slots within an article that the page marks are safe, as ever.
    by_name=False: the tree alone everywhere, marked articles ignored; by_name=True: names everywhere, beside the tree.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of().alias("host"))
    seen = staged(observed(rows.select("host", "html"), bool(by_name)), "seen")
    pruned = unimportant(seen, threshold, min_pages=min_pages, by_name=by_name is not False)
    sizes = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n"))
    named = F.col("n") < min_pages if by_name is None else F.lit(by_name)
    hosts = staged(sizes.join(pruned, "host", "left").select("host", "paths", named.alias("named")), "pruned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for batch in batches:
            out = []
            for page_id, url, host, page, paths, by_names in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html", "paths", "named"))):
                if last[0] != host:
                    last = host, frozenset(paths or ())
                text = main_text(page, last[1], by_names is not False, by_name is not False)
                out.append((page_id, url, text, len(text)))
            yield rows_to_batch(out, _TEXT)

    return rows.join(hosts, "host", "left").select("page_id", "url", "host", "html", "paths", "named").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
