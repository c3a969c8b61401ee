"""IP address expressions (P1d, F7, F8)."""
from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_H = r"[0-9a-fA-F]{1,4}"
# RFC 4291 text forms: full, '::'-compressed, with a trailing dotted quad,
# and an optional zone index after '%'.
_IPV6_FORMS = [
    rf"({_H}:){{7}}{_H}",
    rf"({_H}:){{1,7}}:",
    rf"({_H}:){{1,6}}:{_H}",
    rf"({_H}:){{1,5}}(:{_H}){{1,2}}",
    rf"({_H}:){{1,4}}(:{_H}){{1,3}}",
    rf"({_H}:){{1,3}}(:{_H}){{1,4}}",
    rf"({_H}:){{1,2}}(:{_H}){{1,5}}",
    rf"{_H}:(:{_H}){{1,6}}",
    rf":((:{_H}){{1,7}}|:)",
    rf"({_H}:){{6}}{_IPV4}",
    rf"::({_H}:){{0,5}}{_IPV4}",
    rf"({_H}:){{1}}:({_H}:){{0,4}}{_IPV4}",
    rf"({_H}:){{2}}:({_H}:){{0,3}}{_IPV4}",
    rf"({_H}:){{3}}:({_H}:){{0,2}}{_IPV4}",
    rf"({_H}:){{4}}:({_H}:){{0,1}}{_IPV4}",
    rf"({_H}:){{5}}:{_IPV4}",
]
IPV4_PATTERN = rf"^{_IPV4}$"
IPV6_PATTERN = "^(" + "|".join(_IPV6_FORMS) + r")(%[^%]+)?$"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def ipv4_valid(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def ipv6_valid(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV6_PATTERN), F.lit(False))


def ip_valid(ip: Column) -> Column:
    s = strip_ws(ip)
    return ipv4_valid(s) | ipv6_valid(s)


def ipv4_to_long(ip: Column) -> Column:
    return F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"),
                       lambda acc, x: acc * 256 + x.cast("long"))


def _ranges():
    out = []
    for cidr in config.NAT_RANGES:
        net = ipaddress.ip_network(cidr, strict=False)
        out.append((int(net.network_address), int(net.broadcast_address)))
    return out


def is_carrier_nat(ip: Column) -> Column:
    """IPv4 inside one of the NAT ranges; IPv6 never matches."""
    n = ipv4_to_long(ip)
    inside = None
    for lo, hi in _ranges():
        cond = n.between(F.lit(lo), F.lit(hi))
        inside = cond if inside is None else (inside | cond)
    return F.when(ipv4_valid(ip), inside).otherwise(F.lit(False))


def ip_confidence(nat: Column) -> Column:
    """F8."""
    return F.when(nat, F.lit(config.NAT_CONFIDENCE)).otherwise(F.lit(config.FULL_CONFIDENCE))
