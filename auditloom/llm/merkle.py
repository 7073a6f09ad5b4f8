"""Merkle manifest of a dataset, with inclusion proofs found by coordinate lookup.

Leaves have a place within their source; runs of `FAN` consecutive nodes give the nodes of the next level, down to one
for each source (its subroot), and the subroots, in order of their sources, give the root the same way. The node table is
materialised level by level as runs: tree, level, run -> the hashes of its members. A proof is no walk through the tree:
a leaf's place and the sizes of its source and of the top tree say at once which coordinates (tree, level, run, slots)
hold its siblings; leaves explode these, join the node table, and order, concatenate and fold what they find.

Places come from a range partitioning and the counts of its parts, so no source is one task's work. Lower levels are
joined by coordinate; levels from which on the whole table has at most `broadcast_runs` runs, whose members are bounded,
go to the tasks, so that the coordinates near the root, which all leaves ask for, are no hot keys. Found siblings are
gathered by neighbourhoods of leaves, which share most of them.

Edge cases: null fields hash as "-"; rows with a null doc_id come first in their source and aren't tampered with; rows
that repeat a doc_id are leaves of their own, in the order of their hashes; a lone leaf is its subroot, a lone subroot
the root, and an empty proof hashes nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import staged

FAN = 16
_BITS = 4
#: The tree whose leaves are the subroots.
TOP = -1
_LEVELS = [FAN**i for i in range(15)]


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def lowered(text: Column) -> Column:
    """text with A-Z in lower case; the tampering that a verifier has to notice."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels_of(n: Column) -> Column:
    """Levels of runs above n leaves, none above one."""
    return F.size(F.filter(F.array(*(F.lit(x) for x in _LEVELS)), lambda x: x < n))


# ---------------------------------------------------------------- places
def ranked(rows: DataFrame, tree: str, order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `at`, written in order; spans: part, tree, first, before, n).

    `at` numbers rows in order, with gaps between parts; a row's place in its tree is at - first + before of its part's
    span, n the tree's size. There is a span for each tree in each part.
    """
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), f"{tag}-rows")  # equal rows fill several ranges, the same ones each time
    keys = [tree, *order, "_row"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    dealt = staged(dealt.withColumn("at", F.monotonically_increasing_id()), tag)
    spans = dealt.groupBy(part_of(), tree).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    upto = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part at most
    spans = spans.select("part", tree, "first", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy(tree)).alias("n"))
    return dealt, staged(spans, f"{tag}-spans")


def part_of() -> Column:
    return F.shiftright("at", 33).alias("part")


def placed(rows: DataFrame, spans: DataFrame, tree: str) -> DataFrame:
    """rows with part and the columns of their spans, `place` among them."""
    out = rows.withColumn("part", part_of()).join(small(spans), ["part", tree])
    return out.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("first", "before", "at", "part")


def small(table: DataFrame, most_rows: int = 50_000, most_bytes: int = 16 << 20) -> DataFrame:
    """table, to be broadcast if it is counted to be small."""
    sizes = [F.sum(F.coalesce(F.octet_length(c), F.lit(0))).alias(c) if t == "string" else F.lit(0).alias(c) for c, t in table.dtypes]
    n, *held = table.agg(F.count("*"), *sizes).first()
    return F.broadcast(table) if n <= most_rows and sum(x or 0 for x in held) <= most_bytes else table


# ---------------------------------------------------------------- the node table
def level_up(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of nodes (tree, place, n, hash): tree, level, run, n, members (their hashes in order)."""
    run = F.shiftright("place", _BITS)
    held = nodes.groupBy("tree", run.alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("m"))
    return held.select("tree", F.lit(level).alias("level"), "run", "n", F.transform("m", lambda x: x["hash"]).alias("members"))


def built(leaves: DataFrame, tag: str) -> tuple[DataFrame | None, DataFrame]:
    """(all runs above leaves (tree, place, n, hash); tree, hash of the last node of each tree)."""
    deepest = leaves.agg(F.max(levels_of(F.col("n")))).first()[0] or 0
    runs, tops = None, leaves.where("n = 1").select("tree", "hash")
    nodes = leaves.where("n > 1")
    for level in range(deepest):
        made = staged(level_up(nodes, level), f"{tag}{level}")
        runs = made if runs is None else runs.unionByName(made)
        above = made.select("tree", F.col("run").alias("place"), F.floor((F.col("n") + FAN - 1) / FAN).cast("bigint").alias("n"), F.sha2(F.array_join("members", ""), 256).alias("hash"))
        tops = tops.unionByName(above.where("n = 1").select("tree", "hash"))
        nodes = above.where("n > 1")
    return runs, staged(tops, f"{tag}-tops")


# ---------------------------------------------------------------- proofs
def coordinates(tree: Column, place: Column, n: Column, first_step: Column) -> Column:
    """For each level: step (its place in the proof), tree, level, run, slot (the node's own) and slots (of its siblings)."""

    def one(level: Column) -> Column:
        own = F.call_function("shiftright", place, _BITS * level)
        nodes = F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1).cast("bigint"), _BITS * level) - 1, _BITS * level)
        run, slot = F.shiftright(own, _BITS), F.pmod(own, F.lit(FAN)).cast("int")
        size = F.least(F.lit(FAN).cast("bigint"), nodes - run * FAN).cast("int")
        slots = F.filter(F.sequence(F.lit(0), size - 1), lambda i: i != slot)
        return F.struct((first_step + level).alias("step"), tree.alias("tree"), level.alias("level"), run.alias("run"), slot.alias("slot"), slots.alias("slots"))

    levels = levels_of(n)
    return F.when(levels > 0, F.transform(F.sequence(F.lit(0), levels - 1), one)).otherwise(F.array().cast("array<struct<step:int,tree:bigint,level:int,run:bigint,slot:int,slots:array<int>>>"))


def proved(leaves: DataFrame, runs: DataFrame | None, broadcast_runs: int = 20_000) -> DataFrame:
    """leaves (tree, place, n, top_place, top_n and their own columns, one struct `own`) with proof: an array of slot, siblings from the leaf's run to the root's."""
    leaf = ["tree", "place"]
    found = leaves.select(*leaf, "own", F.lit(None).cast("struct<step:int,slot:int,siblings:array<string>>").alias("s"))
    if runs is not None:
        wanted = F.concat(coordinates(F.col("tree"), F.col("place"), F.col("n"), F.lit(0)), coordinates(F.lit(TOP).cast("bigint"), F.col("top_place"), F.col("top_n"), levels_of(F.col("n"))))
        asked = leaves.select(*leaf, F.explode(wanted).alias("c")).select(*(F.col(k).alias(f"leaf_{k}") for k in leaf), "c.*")
        low, high = split(runs, broadcast_runs)
        key = ["tree", "level", "run"]
        siblings = F.transform("slots", lambda i: F.get("members", i))
        for table, levels in ((low, ~high), (F.broadcast(runs.where(high)), high)):
            if table is None:
                continue
            met = asked.where(levels).join(table.select(*key, "members"), key)
            met = met.select(*(F.col(f"leaf_{k}").alias(k) for k in leaf), F.lit(None).cast(leaves.schema["own"].dataType).alias("own"), F.struct("step", "slot", siblings.alias("siblings")).alias("s"))
            found = found.unionByName(met)
    near = F.shiftright("place", 2 * _BITS)
    dealt = found.withColumn("near", near).repartition("tree", "near")
    # sort_array puts the leaf's own row, which has no step, first.
    return dealt.groupBy("tree", "near", "place").agg(F.max("own").alias("own"), F.sort_array(F.collect_list("s")).alias("proof"))


def split(runs: DataFrame, broadcast_runs: int) -> tuple[DataFrame | None, Column]:
    """(runs to be joined by coordinate, None if there are none; which levels, counted, are small enough to be broadcast)."""
    top = F.col("tree") == TOP
    sizes = {(r.top, r.level): r.n for r in runs.groupBy(top.alias("top"), "level").agg(F.count("*").alias("n")).collect()}  # a row for each level
    left, high = broadcast_runs, F.lit(False)
    kept = 0
    for (is_top, level), n in sorted(sizes.items(), key=lambda x: x[1]):
        left -= n
        if left < 0:
            break
        high, kept = high | ((top == is_top) & (F.col("level") == level)), kept + 1
    return (runs.where(~high) if kept < len(sizes) else None), high


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""

    def up(held: Column, s: Column) -> Column:
        sib, slot = s["siblings"], s["slot"]
        return F.sha2(F.concat(F.array_join(F.slice(sib, 1, slot), ""), held, F.array_join(F.slice(sib, slot + 1, F.lit(FAN)), "")), 256)

    return F.aggregate(proof, start, up)


def manifest(docs: DataFrame, fold_from: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (array of slot, siblings), proof_sha256, folded_root, verified.

    docs has doc_id, source, lang, n_chars, text. fold_from, an expression on docs, is the text from whose leaf the root is folded
    anew; without it each row's own.
    """
    shown = F.col("text") if fold_from is None else fold_from
    fields = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "n_chars", "text", shown.alias("shown"))
    # Null comes first, then UTF-8 order, as Spark compares strings.
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    other = F.when(~F.col("shown").eqNullSafe(F.col("text")), leaf_hash(F.col("shown")))
    hashes = fields.select("doc_id", source.alias("source"), leaf_hash(F.col("text")).alias("leaf"), other.alias("other"))
    rows, spans = ranked(hashes, "source", ["doc_id", "leaf"], "leaves")
    groups, group_spans = ranked(spans.select("source").distinct().withColumn("all", F.lit(0)), "all", ["source"], "sources")
    trees = staged(placed(groups, group_spans, "all").select("source", F.col("place").alias("tree"), F.col("n").alias("top_n")), "trees")
    spans = staged(spans.join(trees, "source"), "spans")
    leaves = placed(rows, spans, "source").drop("source")
    runs, tops = built(leaves.select("tree", "place", "n", F.col("leaf").alias("hash")), "runs")
    top_leaves = staged(tops.join(trees, "tree").select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.col("top_n").alias("n"), "hash"), "subroots")
    top_runs, roots = built(top_leaves, "top-runs")
    if top_runs is not None:
        runs = top_runs if runs is None else runs.unionByName(top_runs)
    root = roots.first()
    subroots = spans.join(tops.select("tree", F.col("hash").alias("subroot")), "tree")
    leaves = placed(rows, staged(subroots, "subroot-spans"), "source")
    own = F.struct("doc_id", "leaf", "other", "subroot")
    out = proved(leaves.select("tree", "place", "n", F.col("tree").alias("top_place"), "top_n", own.alias("own")), runs)
    out = out.select("own.*", F.filter("proof", lambda s: s.isNotNull()).alias("proof"))
    root_hash = F.lit(root.hash if root else None).cast("string")
    out = out.select("doc_id", "leaf", "subroot", root_hash.alias("root"), "proof", F.sha2(F.array_join(F.flatten(F.transform("proof", lambda s: s["siblings"])), ""), 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(every: int = 5) -> Column:
    """The text, in lower case where `every` divides the crc32 of the decimal doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, lowered(F.col("text"))).otherwise(F.col("text"))
