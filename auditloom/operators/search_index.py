"""Substring search over texts by an index of trigrams.

The index has, for each trigram of the lower-case texts, the numbers of the rows that have it, in blocks of 65,536 rows as
sorted arrays of offsets. Files are laid out by shelves of trigrams and sorted within, so a search reads the postings of
its needle's trigrams only: shelves by partition pruning, trigrams by the statistics of the files. Rows that have all of
the needle's rarest trigrams are looked up and verified; the result is that of reading all texts. Needles of fewer than
three characters have no trigram, and all texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK_BITS = 16
#: So many of a needle's trigrams, the rarest, are intersected; the rest would cost more than verifying.
_MOST_GRAMS = 6


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text, in code points."""
    n = F.char_length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, 3)))).otherwise(F.array().cast("array<string>"))


class TextIndex:
    """An index under a folder that all executors share: texts, postings and how many rows have each trigram."""

    def __init__(self, spark: SparkSession, path: str, shelves: int = 64):
        self.spark, self.path, self.shelves = spark, path.rstrip("/"), shelves

    def shelf(self, gram: Column) -> Column:
        return F.pmod(F.hash(gram), F.lit(self.shelves))

    def build(self, rows: DataFrame, text: Column) -> TextIndex:
        """Indexes rows by a text; the rows themselves come back from searches."""
        numbered = rows.withColumns({"_text": F.lower(F.coalesce(text, F.lit(""))), "_row": F.monotonically_increasing_id()})
        numbered.write.parquet(f"{self.path}/rows")
        held = self.rows().select("_row", F.explode(trigrams(F.col("_text"))).alias("gram"))
        block, offset = F.shiftright("_row", _BLOCK_BITS), F.col("_row").bitwiseAND((1 << _BLOCK_BITS) - 1).cast("int")
        lists = held.groupBy("gram", block.alias("block")).agg(F.sort_array(F.collect_list(offset)).alias("offsets"))  # 65,536 at most
        lists = lists.withColumn("shelf", self.shelf(F.col("gram"))).repartition("shelf", F.pmod(F.hash("block"), F.lit(8))).sortWithinPartitions("shelf", "gram", "block")
        lists.write.partitionBy("shelf").parquet(f"{self.path}/postings")
        sizes = self.postings().groupBy("gram", "shelf").agg(F.sum(F.size("offsets")).cast("bigint").alias("n"))
        sizes.repartition("shelf").sortWithinPartitions("shelf", "gram").write.partitionBy("shelf").parquet(f"{self.path}/sizes")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, block bigint, offsets array<int>, shelf int").parquet(f"{self.path}/postings")

    def of_grams(self, table: DataFrame, grams: list[str]) -> DataFrame:
        shelves = [r.s for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(self.shelf(F.col("g")).alias("s")).distinct().collect()]
        return table.where(F.col("shelf").isin(shelves) & F.col("gram").isin(grams))

    def candidates(self, needle: str) -> DataFrame | None:
        """_row of rows that have the rarest trigrams of a needle (in lower case); None if it has no trigram."""
        grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        if not grams:
            return None
        sizes = self.spark.read.schema("gram string, n bigint, shelf int").parquet(f"{self.path}/sizes")
        known = {r.gram: r.n for r in self.of_grams(sizes, grams).collect()}  # a row for each trigram of the needle
        if len(known) < len(grams):
            return self.rows().select("_row").where("false")
        rarest = sorted(grams, key=lambda g: (known[g], g))[:_MOST_GRAMS]
        found = self.of_grams(self.postings(), rarest).groupBy("block").agg(F.collect_list("offsets").alias("lists")).where(F.size("lists") == len(rarest))
        common = F.aggregate(F.slice("lists", 2, len(rarest)), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
        return found.select(F.explode(F.transform(common, lambda o: F.shiftleft("block", _BLOCK_BITS) + o)).alias("_row"))

    def containing(self, needle: str) -> DataFrame:
        """The rows whose text has the needle, in any case."""
        needle = needle.lower()
        rows, met = self.rows(), self.candidates(needle)
        if met is not None:
            rows = rows.join(met, "_row", "left_semi")
        return rows.where(F.col("_text").contains(needle)).drop("_row", "_text")
