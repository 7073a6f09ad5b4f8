"""Which base URLs may be crawled."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.addresses import intervals, ipv4, ipv6, within
from auditloom.functions.text import present, trim
from auditloom.functions.urls import rtrim_slash

#: Private and reserved networks.
IPV4 = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("0.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("240.0.0.0", 4)]
IPV6 = ["fc00::/7", "::/128", "::1/128", "::ffff:0:0/96", "fe80::/10", "2001:db8::/32", "5f00::/8", "3ff3::/16"]
#: What the guard says.
REQUIRED = "A website URL is required."
INVALID = "Enter a valid absolute URL starting with http:// or https://."
BAD_SCHEME = "Only http:// and https:// URLs are allowed."
NO_HOST = "The URL must include a hostname."
PRIVATE_NAME = "Private or local network targets are not allowed."
PRIVATE_ADDRESS = "The hostname resolves to a private or reserved IP address and cannot be crawled."

_HOST = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.?\z"


number_of = ipv4


def blocked_ipv6(ip: Column) -> Column:
    """Whether an IPv6 address is private or reserved; null if it's none. By a sorted table of intervals of two longs, in the JVM."""
    address = F.transform(F.array(ipv6(ip)), lambda a: within(a, intervals(IPV6)))
    return F.get(address, F.lit(0))


def blocked_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is private or reserved; null if it's none. By ranges of longs, in the JVM."""
    n, hit = number_of(ip), F.lit(False)
    for base, bits in IPV4:
        low = int(ipaddress.ip_address(base))
        hit = hit | n.between(low, low + (1 << (32 - bits)) - 1)
    return hit


def is_blocked_address(ip: Column) -> Column:
    return F.coalesce(blocked_ipv4(ip), blocked_ipv6(ip), F.lit(True))


def guarded(urls: DataFrame, dns: DataFrame | None = None, ipv6: bool = True) -> DataFrame:
    """urls (base_url) with ok, error (the first that applies) and url (without trailing slashes).

    dns (host, ips array) says what hosts resolve to; hosts that it doesn't list pass. ipv6 False leaves bracketed
    addresses out of consideration.
    """
    raw = trim(present(F.col("base_url")))
    rows = urls.withColumn("_raw", raw)
    rows = rows.withColumn("_scheme", F.lower(F.regexp_extract("_raw", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)))
    rows = rows.withColumn("_host", F.lower(F.regexp_extract("_raw", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)))
    bare = F.regexp_replace("_host", r"^\[|\]\z", "")
    rows = rows.withColumn("_bare", bare).withColumn("_v6", F.when(F.col("_host").startswith("["), blocked_ipv6(F.when(F.col("_host").startswith("["), F.col("_bare")))) if ipv6 else F.lit(None).cast("boolean"))
    web = F.col("_scheme").isin("http", "https")
    well_formed = F.col("_raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[\x21-\x7E]+\z") & F.when(web, F.col("_host").rlike(_HOST) | F.col("_v6").isNotNull()).otherwise(F.col("_raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?[\x21-\x7E]+\z"))
    v4 = blocked_ipv4(F.col("_host"))
    is_ip = number_of(F.col("_host")).isNotNull() | F.col("_v6").isNotNull()
    local = (F.col("_host") == "localhost") | F.col("_host").endswith(".localhost") | F.col("_host").endswith(".local")
    private = local | (~F.col("_host").contains(".") & ~is_ip) | F.coalesce(v4, F.lit(False)) | F.coalesce(F.col("_v6"), F.lit(False))
    if dns is None:
        rows = rows.withColumn("_resolves", F.lit(False))
    else:
        bad = dns.select(F.lower("host").alias("_host"), F.explode("ips").alias("ip")).where(is_blocked_address(F.col("ip")) if ipv6 else F.coalesce(blocked_ipv4(F.col("ip")), F.lit(False)))
        rows = rows.join(bad.select("_host", F.lit(True).alias("_bad")).distinct(), "_host", "left").withColumn("_resolves", F.coalesce("_bad", F.lit(False))).drop("_bad")
    error = (
        F.when(F.col("_raw") == "", F.lit(REQUIRED))
        .when(~F.coalesce(well_formed, F.lit(False)), F.lit(INVALID))
        .when(~web, F.lit(BAD_SCHEME))
        .when(F.col("_host") == "", F.lit(NO_HOST))
        .when(private, F.lit(PRIVATE_NAME))
        .when(F.col("_resolves") & ~is_ip, F.lit(PRIVATE_ADDRESS))
        .otherwise("")
    )
    rows = rows.withColumn("error", error)
    return rows.select(*urls.columns, (F.col("error") == "").alias("ok"), "error", F.when(F.col("error") == "", rtrim_slash(F.col("_raw"))).otherwise("").alias("url"))


def hosts(urls: DataFrame) -> DataFrame:
    """host: the distinct names among the hosts of urls (base_url), which are to be looked up; addresses are none."""
    host = F.lower(F.regexp_extract(trim(present(F.col("base_url"))), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\[]+)", 1))
    return urls.select(host.alias("host")).where((F.col("host") != "") & number_of(F.col("host")).isNull()).distinct()


def inserted(reports: DataFrame, new: DataFrame, dns: DataFrame | None = None, ipv6: bool = True) -> tuple[DataFrame, DataFrame]:
    """(reports with those of new, of the same columns, whose base URL passes, as the guard writes it; the others with their error)."""
    names = reports.columns
    judged = guarded(new, dns, ipv6)
    good = judged.where("ok").withColumn("base_url", F.col("url"))
    return reports.unionByName(good.select(*names)), judged.where("not ok").select(*names, "error")
