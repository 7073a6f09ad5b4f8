"""Line-first quality rules, with DataFrame functions only.

Rules are read line by line. Punctuation: a line falls when symbols drown its words, when it runs on without any
sentence mark, or when it has many words and no sentence ends in it; marks are those of all scripts, and lines of scripts that need
none aren't judged by marks. Navigation: when dividers part it into menu entries, or when it stands in a run of lines of
few words that neither end nor pause a sentence, with no short line beside them that does, as verse has. Boilerplate: when it is short and
has a phrase of page furniture, or when it repeats an earlier line. Fallen lines are removed; then a document that lost
more than a stated share of its characters is rejected, whatever lines it keeps.

Edge cases: a null, empty or blank text has no words and fails the base test; extra columns are carried untouched;
each row is judged by itself, so repeated rows get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import SPACE_CLASS, words_of

#: Characters that count as symbols; marks that end a sentence, in any script; marks that divide one; closing
#: quotes and brackets; scripts whose sentences need no marks (Thai, Lao, Tibetan, Myanmar, Khmer).
SYMBOLS = "[#*$%&|<>]"
ENDS = ".!?…。！？｡．؟۔।॥։።፧။៕᙮᠃᠉"
PAUSES = ";:,、，；：؛،፣፤፥;"
CLOSERS = r"\"'”’»)\]」』】）〉》"
UNMARKED = "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff]"
MENU_DIVIDERS = "[|»›·•]"
#: A word; any mark of a sentence; marks that end one; marks behind which a line may stop; phrases of page furniture.
WORD = rf"[^{SPACE_CLASS}]+"
SENTENCE_MARKS = f"[{ENDS}{PAUSES}]"
SENTENCE_ENDS = f"[{ENDS}]"
PAUSE_AT_END = rf"[{ENDS}{PAUSES}][{CLOSERS}]*[{SPACE_CLASS}]*$"
#: The same for Latin text, which Java matches much faster, and the range in which all other marks lie.
_LATIN = {SENTENCE_MARKS: "[.!?;:,…]", SENTENCE_ENDS: "[.!?…]", PAUSE_AT_END: rf"[.!?…:;,][\"'”’»)\]]*[{SPACE_CLASS}]*$"}
_OTHER_SCRIPT = "[\u0370-\u1fff\u2070-\ud7ff\uf900-\uffef]"
BOILERPLATE = (
    "(?i)(all rights reserved|terms of use|terms of service|privacy policy|cookie policy|uses? cookies|accept cookies|enable javascript|javascript is disabled|click here|read more|"
    "sign in|sign up|log in|subscribe to|newsletter|share this|follow us|powered by|skip to (main )?content|back to top|add to cart)"
)
WINDOW = 5


def window_hashes_of(words: Column) -> Column:
    """64-bit hashes of the runs of five words, in order."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(n >= WINDOW, runs).otherwise(F.array().cast("array<bigint>"))


def words_under(starts: Column) -> Column:
    """Words that runs of five words at these ascending starts cover together."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("bigint").alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


#: Kinds of short lines.
ENTRY, VERSE = 1, 2


def has(line: Column, pattern: str) -> Column:
    """line.rlike(pattern) for a pattern of _LATIN; the long one is only tried on lines with a character of another script."""
    return line.rlike(_LATIN[pattern]) | (line.rlike(_OTHER_SCRIPT) & line.rlike(pattern))


def shortness(line: Column, menu_words: int, verse_chars: int) -> Column:
    """ENTRY of few words that neither end nor pause a sentence, as the entries of menus do; VERSE, a short line that does."""
    verse = F.when(F.length(line) <= verse_chars, F.lit(VERSE)).otherwise(0)
    return F.when(has(line, PAUSE_AT_END), verse).when((F.regexp_count(line, F.lit(WORD)) <= menu_words) & ~line.rlike(UNMARKED), F.lit(ENTRY)).otherwise(0)


def falls(line: Column, max_symbol_share: float, menu_entry_chars: int, run_on_chars: int, open_words: int, boilerplate_chars: int) -> Column:
    """Whether a line falls by what it is itself."""
    n = F.length(line)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > n * max_symbol_share
    dividers = F.regexp_count(line, F.lit(MENU_DIVIDERS)) * menu_entry_chars > n
    run_on = (n >= run_on_chars) & ~has(line, SENTENCE_MARKS)
    unended = ~has(line, SENTENCE_ENDS) & (F.regexp_count(line, F.lit(WORD)) >= open_words)
    return symbols | dividers | ((run_on | unended) & ~line.rlike(UNMARKED)) | ((n <= boilerplate_chars) & line.rlike(BOILERPLATE))


#: Columns that judge() adds: counts, the lines that stand, and verdicts.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lost_chars"]
CLEANED = "clean_text"
VERDICTS = ["base_failed", "kept"]
#: Bounds of the line rules.
RULES = {"max_symbol_share": 0.1, "menu_entry_chars": 20, "run_on_chars": 240, "open_words": 10, "boilerplate_chars": 120, "menu_words": 3, "menu_lines": 3, "verse_chars": 60, "verse_lines": 3}


def _judged(docs: DataFrame, max_lost_share: float, **rules: float) -> DataFrame:
    """_row (the row as it came), MEASURES, CLEANED and VERDICTS.

    Arrays that a lambda reads by place stand in projections of their own: within the lambda they would be built anew
    for each element. Only texts with a repeated run, few of them, are sorted to find where repeats lie.
    """
    rules = {**RULES, **rules}
    menu_words, menu_lines, verse_chars, verse_lines = (int(rules.pop(k)) for k in ("menu_words", "menu_lines", "verse_chars", "verse_lines"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row"))
    rows = rows.select("_row", words_of(F.col("_row.text")).alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("_lines"))
    rows = rows.select("*", window_hashes_of(F.col("_words")).alias("_hashes"), F.array_distinct("_lines").alias("_distinct"))
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    short = F.transform("_distinct", lambda x: shortness(x, menu_words, verse_chars))
    rows = rows.select("*", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed).alias("_placed"), short.alias("_short"))
    same = lambda x, other: F.coalesce(x["h"] == F.get("_placed", other)["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("_placed", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def in_menu(i: Column) -> Column:
        kind = lambda d: F.coalesce(F.get("_short", i + d), F.lit(0))
        at = [kind(d) == ENTRY for d in range(1 - menu_lines, menu_lines)]
        run = functools.reduce(operator.or_, (functools.reduce(operator.and_, at[d : d + menu_lines]) for d in range(menu_lines)))
        near = functools.reduce(operator.or_, (kind(d) == VERSE for d in range(-verse_lines, verse_lines + 1) if d))
        return run & ~near

    verdicts = F.transform("_distinct", lambda x, i: F.struct(x.alias("line"), (falls(x, **rules) | in_menu(i)).alias("bad")))
    rows = rows.select("_row", "_words", "_lines", "_distinct", starts.alias("_starts"), F.transform(F.filter(verdicts, lambda v: ~v["bad"]), lambda v: v["line"]).alias("_good"))
    chars = F.length(F.array_join("_words", "")).cast("bigint")
    line_chars = F.aggregate("_lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    good_chars = F.aggregate("_good", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    base = (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    # A filter on what explode() makes stays above it; else Spark would copy these expressions into the filter.
    rows = rows.select(
        "_row",
        F.explode(
            F.array(
                F.struct(
                    F.size("_words").cast("bigint").alias("n_words"),
                    chars.alias("word_chars"),
                    F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                    (F.size("_lines") - F.size("_distinct")).cast("bigint").alias("n_dup_lines"),
                    F.coalesce(words_under(F.col("_starts")), F.lit(0).cast("bigint")).alias("n_repeat_words"),
                    line_chars.alias("line_chars"),
                    good_chars.alias("_good_chars"),
                    F.array_join("_good", "\n").alias("clean_text"),
                )
            )
        ).alias("m"),
    )
    rows = rows.select("_row", *(F.col(f"m.{c}") for c in MEASURES[:-1]), (F.col("m.line_chars") - F.col("m._good_chars")).alias("lost_chars"), F.col(f"m.{CLEANED}").alias(CLEANED), base.alias("base_failed"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost_share * F.col("line_chars")))


def judge(docs: DataFrame, max_lost_share: float = 0.5, **rules: float) -> DataFrame:
    """Each row of docs with MEASURES (long), CLEANED (string) and VERDICTS (boolean); columns of docs with such a name give way.

    kept: not base_failed, and at most max_lost_share of the characters of lines with a word lie on fallen or repeated
    lines. rules: other values for RULES.
    """
    out = _judged(docs, max_lost_share, **rules)
    return out.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in [*MEASURES, CLEANED, *VERDICTS]), *MEASURES, CLEANED, *VERDICTS)


def clean(docs: DataFrame, max_lost_share: float = 0.5, **rules: float) -> DataFrame:
    """The rows of docs that judge() keeps, without their fallen, repeated and blank lines, with exactly the columns of docs.

    n_chars, where docs has it, is counted anew. Lines that stand are joined by a line feed.
    """
    rows = _judged(docs, max_lost_share, **rules).where("kept")
    anew = {"text": F.col(CLEANED), "n_chars": F.length(CLEANED)}
    types = dict(docs.dtypes)
    return rows.select(*(anew[c].cast(types[c]).alias(c) if c in anew else F.col(f"_row.`{c}`") for c in docs.columns))
