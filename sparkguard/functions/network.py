"""IPv4 addresses and ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_number(ip: Column) -> Column:
    """Dotted text to its 32-bit number; null for anything else."""
    part = F.split(ip, r"\.")
    number = sum((part[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), part[0].cast("long") * 256**3)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def network_of(number: Column, prefix: int | Column) -> Column:
    """Network number of an address for a prefix length."""
    size = F.pow(F.lit(2), 32 - prefix).cast("long") if isinstance(prefix, Column) else F.lit(2 ** (32 - prefix))
    return number - number % size


def networks(entries: list[str]) -> list[tuple[int, int]]:
    """(prefix length, network number) of addresses and CIDR texts."""
    out = []
    for e in entries:
        net = ipaddress.ip_network(e, strict=False)
        out.append((net.prefixlen, int(net.network_address)))
    return sorted(set(out))
