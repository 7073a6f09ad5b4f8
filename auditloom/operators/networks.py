"""Which networks addresses belong to, for tables of networks of any size.

A network is its prefix: its length and the address cut to it. Networks come in few lengths (33 and 129 at most), so an
address is cut to each length that occurs, and these prefixes meet the networks in an equality join; no interval is searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.addresses import ipv4, ipv6

_LEAST = -(1 << 63)
_KEY = ["bits", "size", "high", "low"]


def numbered(ip: Column) -> Column:
    """bits (32 or 128), high, low of an address; null if it's none."""
    four = ipv4(ip)
    six = F.transform(F.array(ipv6(ip)), lambda s: F.when(s.isNotNull(), F.struct(F.lit(128).alias("bits"), s["high"].alias("high"), s["low"].alias("low"))))
    return F.when(four.isNotNull(), F.struct(F.lit(32).alias("bits"), F.lit(0).cast("bigint").alias("high"), four.alias("low"))).otherwise(F.get(six, F.lit(0)))


def cut(number: Column, size: Column) -> Column:
    """high and low of an address of numbered(), with all bits behind the first `size` cleared."""
    low_bits = F.when(number["bits"] == 32, F.lit(32) - size).otherwise(F.least(F.lit(128) - size, F.lit(64)))
    high_bits = F.when(number["bits"] == 32, F.lit(0)).otherwise(F.greatest(F.lit(64) - size, F.lit(0)))
    # Halves of IPv6 addresses are moved by 2**63; clearing bits is done on what they stand for.
    clear = lambda x, n: F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, n), n))
    moved = F.when(number["bits"] == 32, F.lit(0).cast("bigint")).otherwise(F.lit(_LEAST))
    return F.struct(clear(number["high"].bitwiseXOR(moved), high_bits).alias("high"), clear(number["low"].bitwiseXOR(moved), low_bits).alias("low"))


def prefixes(networks: DataFrame) -> DataFrame:
    """networks (network as address/size) with bits, size, high, low; rows that are no network go."""
    rows = networks.withColumn("size", F.split_part("network", F.lit("/"), F.lit(2)).try_cast("int")).withColumn("_a", numbered(F.split_part("network", F.lit("/"), F.lit(1))))
    rows = rows.where(F.col("size").between(0, F.col("_a.bits"))).withColumn("_p", cut(F.col("_a"), F.col("size")))
    return rows.select(*networks.columns, F.col("_a.bits").alias("bits"), "size", F.col("_p.high").alias("high"), F.col("_p.low").alias("low"))


def matched(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """addresses (ip and own columns) with network: the smallest of networks (network) that holds each, null if none does."""
    known = prefixes(networks.select("network").distinct())
    lengths = {bits: sorted(r.size for r in known.where(F.col("bits") == bits).select("size").distinct().collect()) for bits in (32, 128)}  # 162 at most
    sizes = lambda bits: F.array(*(F.lit(s) for s in lengths[bits])).cast("array<int>")
    rows = addresses.withColumn("_row", F.monotonically_increasing_id()).withColumn("_a", numbered(F.col("ip")))
    tried = rows.select(*addresses.columns, "_row", "_a", F.explode_outer(F.when(F.col("_a.bits") == 32, sizes(32)).when(F.col("_a.bits") == 128, sizes(128))).alias("size"))
    tried = tried.withColumn("_p", cut(F.col("_a"), F.col("size"))).withColumns({"bits": F.col("_a.bits"), "high": F.col("_p.high"), "low": F.col("_p.low")}).drop("_p", "_a")
    # Of networks that are written in several ways, one counts.
    one = known.groupBy(*_KEY).agg(F.min("network").alias("network"))
    met = tried.join(one, _KEY, "left")
    best = F.max_by("network", F.when(F.col("network").isNotNull(), F.col("size")))
    return met.groupBy(*addresses.columns, "_row").agg(best.alias("network")).drop("_row")
