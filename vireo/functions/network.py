"""Network keys of client addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _groups(ip: Column) -> Column:
    """The eight groups of an IPv6 address, '::' expanded."""
    left = F.substring_index(ip, "::", 1)
    right = F.when(ip.contains("::"), F.substring_index(ip, "::", -1)).otherwise(F.lit(""))
    parts = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    a, b = parts(left), parts(right)
    return F.concat(a, F.array_repeat(F.lit("0"), 8 - F.size(a) - F.size(b)), b)


def client_network(ip: Column) -> Column:
    """IPv4 address as /32; the upper half of an IPv6 address as /64, without leading zeros."""
    upper = F.transform(F.slice(_groups(ip), 1, 4), lambda g: F.lower(F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0"))))
    return F.when(ip.contains(":"), F.concat(F.array_join(upper, ":"), F.lit("::/64"))).otherwise(F.concat(ip, F.lit("/32")))


def concurrency_key(ip: Column) -> Column:
    """The first four colon groups as written (no expansion): not the same key as :func:`client_network`."""
    return F.when(ip.contains(":"), F.substring_index(ip, ":", 4)).otherwise(ip)
