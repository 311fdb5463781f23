"""Address literals as 128 bits, and longest-prefix matches, as column expressions.

An IPv4 address stands for its mapped IPv6 address (::ffff:a.b.c.d), so one table of ranges serves both
and every way of writing an address (compressed, mapped in dotted or hexadecimal form) gives the same bits.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.columns import as_col, bind

_DOTTED = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
_MAPPED = "0" * 80 + "1" * 16


def _none() -> Column:
    return F.array().cast("array<string>")


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint"))


def _four(text: Column) -> Column:
    digits = lambda octets: F.when(
        F.forall(octets, lambda o: o <= 255), F.concat(F.lit(_MAPPED), F.array_join(F.transform(octets, lambda o: F.lpad(F.bin(o), 8, "0")), ""))
    )
    return F.when(text.rlike(f"^{_DOTTED}$"), bind(_octets(text), digits))


def _dotted_tail(text: Column) -> Column:
    """The text with a dotted tail written as two groups; a wrong tail gives a wrong group."""
    tail = F.regexp_extract(text, f":({_DOTTED})$", 1)
    pair = lambda o, i: F.when(o[i] * 256 + o[i + 1] < 65536, F.lower(F.hex(o[i] * 256 + o[i + 1]))).otherwise("-")
    fits = lambda o: F.forall(o, lambda x: x <= 255)
    groups = bind(_octets(tail), lambda o: F.when(fits(o), F.concat(pair(o, 0), F.lit(":"), pair(o, 2))).otherwise("-"))
    return F.when(tail == "", text).otherwise(F.concat(F.regexp_replace(text, f"{_DOTTED}$", ""), groups))


def _six(text: Column) -> Column:
    groups = lambda half: F.when(half == "", _none()).otherwise(F.split(half, ":"))

    def filled(side: Column) -> Column:
        """All eight groups, or NULL."""
        left, right, halves = side["left"], side["right"], side["halves"]
        given = F.size(left) + F.size(right)
        whole = ((halves == 1) & (given == 8)) | ((halves == 2) & (given <= 7))
        return F.when(whole, F.concat(left, F.array_repeat(F.lit("0"), 8 - given), right))

    def bits(every: Column) -> Column:
        valid = F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(valid, F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    sides = lambda halves: F.struct(
        groups(F.get(halves, F.lit(0))).alias("left"), F.coalesce(groups(F.get(halves, F.lit(1))), _none()).alias("right"), F.size(halves).alias("halves")
    )
    split = bind(bind(F.split(_dotted_tail(text), "::"), sides), filled)
    return F.when(text.contains(":"), bind(split, bits))


def address_bits(host) -> Column:
    """The 128 bits of an address literal as text of 0 and 1, or NULL. Brackets must be gone; a zone is left out."""
    return bind(F.lower(F.regexp_replace(as_col(host), "%.*$", "")), lambda text: F.coalesce(_four(text), _six(text)))


def prefix_bits(network: str) -> str:
    """The leading bits that all addresses of a network in CIDR notation share."""
    net = ipaddress.ip_network(network)
    bits = f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]
    return _MAPPED + bits if net.version == 4 else bits


def longest_prefix(bits: Column, networks: dict[str, str]) -> Column:
    """The label of the narrowest of a few networks (CIDR to label) that holds the address, or NULL."""
    prefixes = sorted(((prefix_bits(n), label) for n, label in networks.items()), key=lambda p: -len(p[0]))
    return bind(bits, lambda b: F.coalesce(*[F.when(F.startswith(b, F.lit(prefix)), F.lit(label)) for prefix, label in prefixes]))


def match_networks(rows: DataFrame, bits: str, networks: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with the label of the narrowest network of a table (prefix, label) of any size, or NULL.

    One equi-join on prefixes: each distinct address is asked once for every prefix length that the table has (at most
    129), and the longest hit is kept by one aggregation.
    """
    lengths = sorted(r[0] for r in networks.select(F.length("prefix")).distinct().collect())
    asked = rows.select(bits).where(F.col(bits).isNotNull()).distinct()
    parts = F.array(*[F.substring(bits, 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    asked = asked.select(bits, F.explode(parts).alias("prefix"))
    hits = asked.join(networks.select("prefix", F.col("label").alias("_label")), "prefix")
    best = hits.groupBy(bits).agg(F.max_by("_label", F.struct(F.length("prefix"), "_label")).alias(label))
    return rows.join(best, bits, "left").select(*rows.columns, label)
