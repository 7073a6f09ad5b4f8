"""IP addresses as numbers, in the JVM: IPv4 as a long, IPv6 as two longs whose signed order is the order of addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An IPv4 address in four decimal numbers without leading zeros.
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_LEAST = -(1 << 63)


def ipv4(ip: Column) -> Column:
    """The address as a long; null if it's none."""
    parts = [F.regexp_extract(ip, V4, g).cast("bigint") for g in (1, 2, 3, 4)]
    return F.when(ip.rlike(V4), ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def ipv6_hex(ip: Column) -> Column:
    """The address as 32 hexadecimal digits; null if it's none. The last two groups may be an IPv4 address; zones aren't known."""
    octet = [F.regexp_extract(ip, _TAIL, g).cast("int") for g in (2, 3, 4, 5)]
    group = lambda a, b: F.hex(a * 256 + b)
    whole = F.when(ip.rlike(_TAIL), F.concat(F.regexp_extract(ip, _TAIL, 1), group(octet[0], octet[1]), F.lit(":"), group(octet[2], octet[3]))).otherwise(ip)
    # Each step is bound to a name by transform over one element, so that it is computed once.
    return F.get(F.transform(F.array(F.lower(whole)), _digits), F.lit(0))


def _digits(text: Column) -> Column:
    sides = F.split(text, "::")
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    head, tail = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(head) - F.size(tail)
    short = F.size(sides) == 2
    filled = F.concat(head, F.when(short & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), tail)
    good = (F.size(sides) <= 2) & F.when(short, missing >= 1).otherwise(missing == 0) & F.forall(filled, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
    return F.when(good, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def ipv6(ip: Column) -> Column:
    """The address as a struct of two longs, high and low, each moved by 2**63 so that signed order is theirs; null if it's none."""
    half = lambda h, at: F.conv(F.substring(h, at, 16), 16, -10).cast("bigint").bitwiseXOR(F.lit(_LEAST))
    made = F.transform(F.array(ipv6_hex(ip)), lambda h: F.when(h.isNotNull(), F.struct(half(h, 1).alias("high"), half(h, 17).alias("low"))))
    return F.get(made, F.lit(0))


def halves(address: int) -> tuple[int, int]:
    """high and low of an address's number, as ipv6() gives them."""
    return (address >> 64) + _LEAST, (address & ((1 << 64) - 1)) + _LEAST


def intervals(networks: list[str]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Sorted, disjoint (first, last) of IPv6 networks, as halves; those that meet are one."""
    spans: list[list[int]] = []
    for net in sorted(map(ipaddress.IPv6Network, networks)):
        first, last = int(net.network_address), int(net.broadcast_address)
        if spans and first <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], last)
        else:
            spans.append([first, last])
    return [(halves(a), halves(b)) for a, b in spans]


def within(address: Column, spans: list[tuple[tuple[int, int], tuple[int, int]]]) -> Column:
    """Whether an ipv6() value lies in one of the intervals, which are few; null for null."""
    number = lambda h: F.struct(F.lit(h[0]).cast("bigint").alias("high"), F.lit(h[1]).cast("bigint").alias("low"))
    hit = F.lit(False)
    for first, last in spans:
        hit = hit | ((address >= number(first)) & (address <= number(last)))
    return F.when(address.isNotNull(), hit)
