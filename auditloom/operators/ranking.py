"""Places in a global order, for tables of any size, and pages of rows by key.

Rows are dealt by range of the sort keys and sorted within each range; a row's place is the number of rows in the ranges
before its own plus its place there. So no task sees all rows, and what is summed over ranges is a number for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import trim
from auditloom.operators.crawl import written


def browser_text(text: Column) -> Column:
    """As the browser compares texts: by the rules of languages, without regard to case and accents."""
    return F.collate(text, "UNICODE_CI_AI")


def column_keys(column: str, ascending: bool = True, text_key: Callable[[Column], Column] = browser_text) -> list[Column]:
    """Sort keys of a column as a table in the browser sorts: numbers before texts, texts without regard to case and accents.

    text_key: what texts are compared by; functions.text.plain gives the order of code points that databases have.
    """
    text = F.col(column).cast("string")
    number = F.when(trim(text) != "", text.try_cast("double"))
    keys = [number.isNull(), number, text_key(text)]
    return [k.asc() if ascending else k.desc() for k in keys]


def ranked(rows: DataFrame, keys: list[Column], place: str = "place", partitions: int | None = None) -> DataFrame:
    """rows with their places (from 1) in the order of keys, the last of which should tell all rows apart; written in that order."""
    count = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    # Numbers rise within a range and start anew, from the range's number times 2**33, in the next.
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    out = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(place, (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).cast("bigint")).drop("_at", "_part", "_before")


def page_after(rows: DataFrame, keys: list[str], last: tuple | None, size: int) -> DataFrame:
    """The next `size` rows behind the row whose keys were `last` (None: the first page), by ascending keys.

    The bound on the first key is a filter of its own, which reaches the files; no row before it is sorted or counted.
    """
    if last is not None:
        behind = F.lit(False)
        for i in reversed(range(len(keys))):
            behind = (F.col(keys[i]) > last[i]) | ((F.col(keys[i]) == last[i]) & behind)
        rows = rows.where(F.col(keys[0]) >= last[0]).where(behind)
    return rows.orderBy(*keys).limit(size)
