"""Network addresses as expressions: IPv6 texts as 32 hexadecimal digits, which compare as their numbers do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import blocked_ipv4, let

# Of the addresses that are given out for use, those that no fetch may reach.
ROUTED = ("2000", "3fff")
SPECIAL_IPV6 = ["20010000", "20010db8", "2002"]
# End of fixed values.
MAPPED = "0" * 20 + "ffff"


def _tail_as_groups(c: Column) -> Column:
    """An address whose last part is IPv4 with two groups in its place; null where that part is none."""
    found = F.regexp_extract(c, r"^(?:.*:)(\d+\.\d+\.\d+\.\d+)$", 1)
    part = lambda i: F.lpad(F.lower(F.hex(F.get(F.split(found, r"\."), F.lit(i)).cast("long"))), 2, "0")
    ok = found.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}")
    groups = F.concat(F.regexp_extract(c, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1), part(0), part(1), F.lit(":"), part(2), part(3))
    return F.when(found == "", c).when(ok, groups)


def ipv6_digits(c: Column) -> Column:
    """The 32 digits of an IPv6 address, with ``::``, a zone, or an IPv4 address at its end or not; null where it is none."""

    def expanded(x: Column) -> Column:
        halves = F.split(x, "::")
        groups = lambda h: F.when(F.coalesce(h, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(h, ":"))
        left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        missing = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        fits = F.when(F.size(halves) == 1, missing == 0).when(F.size(halves) == 2, missing >= 1).otherwise(F.lit(False))
        right_form = F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fits & right_form, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))

    return let(_tail_as_groups(F.lower(F.get(F.split(c, "%"), F.lit(0)))), expanded)


def blocked_ipv6(c: Column) -> Column:
    """Whether no fetch may reach an address: only routed unicast space is open, and of mapped IPv4 what is open there."""

    def judged(x: Column) -> Column:
        byte = lambda i: F.conv(F.substring(x, 25 + 2 * i, 2), 16, 10)
        mapped = blocked_ipv4(F.concat_ws(".", *(byte(i) for i in range(4))))
        special = F.substring(x, 1, 8).isin(*(s for s in SPECIAL_IPV6 if len(s) == 8)) | F.substring(x, 1, 4).isin(*(s for s in SPECIAL_IPV6 if len(s) == 4))
        return F.when(x.isNull(), True).when(F.substring(x, 1, 24) == MAPPED, mapped).otherwise(~F.substring(x, 1, 4).between(*ROUTED) | special)

    return let(ipv6_digits(c), judged)


def blocked_address(c: Column) -> Column:
    """The same for either kind; what is no address is blocked."""
    return F.when(c.contains(":"), blocked_ipv6(c)).otherwise(F.coalesce(blocked_ipv4(c), F.lit(True)))
