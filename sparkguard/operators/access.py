"""Access checks: grants, allow-lists, orphaned resources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sparkguard.functions.network import ip_number, network_of, networks
from sparkguard.operators.joining import null_safe_join
from sparkguard.operators.metrics import at


def check_access(requests: DataFrame, grants: DataFrame, as_of: dt.datetime, conditions: list[str], without_context: bool = False) -> DataFrame:
    """Adds ``allowed``: some grant fits principal, resource, permission, time and conditions.

    ``conditions`` are columns of both sides. A null in the grant asks nothing, an array asks for one of
    its values; a null in the request is compared like any value. With ``without_context`` a request whose conditions are all null has
    no context, and no condition is asked of it. Equal requests are decided once: a request shape held by a third of
    the rows is one row in the join with the grants, which may be many.
    """
    shape = ["principal", "resource", "permission", *conditions]
    live = grants.where(F.col("expires_at").isNull() | (F.col("expires_at") >= at(as_of)))
    offered = live.select(
        "principal", "resource", F.explode("permissions").alias("permission"), *[F.col(c).alias(f"want_{c}") for c in conditions]
    ).distinct()
    shapes = requests.select(*shape).distinct()
    keys = ["principal", "resource", "permission"]
    fits = [shapes[k] == offered[k] for k in keys]
    bare = F.lit(without_context and bool(conditions))
    for c in conditions:
        bare = bare & shapes[c].isNull()
    for c in conditions:
        want = F.col(f"want_{c}")
        listed = isinstance(grants.schema[c].dataType, ArrayType)
        met = F.coalesce(F.array_contains(want, shapes[c]), F.lit(False)) if listed else want.eqNullSafe(shapes[c])
        fits.append(want.isNull() | met | bare)
    granted = shapes.join(offered, fits, "left_semi").withColumn("_granted", F.lit(True))
    out = null_safe_join(requests, granted, shape)
    return out.withColumn("allowed", F.coalesce("_granted", F.lit(False))).drop("_granted")


def match_allow_list(connections: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Adds ``allowed`` for a configured list of addresses and CIDR ranges. An empty list and ``0.0.0.0`` allow all."""
    if not allowed or "0.0.0.0" in allowed:
        return connections.withColumn("allowed", F.lit(True))
    number = ip_number(F.col(column))
    by_prefix: dict[int, list[int]] = {}
    for prefix, net in networks(allowed):
        by_prefix.setdefault(prefix, []).append(net)
    hit = F.lit(False)
    for prefix, nets in by_prefix.items():
        hit = hit | network_of(number, prefix).isin(nets)
    return connections.withColumn("allowed", F.coalesce(hit, F.lit(False)))


def match_ranges(connections: DataFrame, column: str, ranges: DataFrame) -> DataFrame:
    """Adds ``allowed`` for a table of ranges (``prefix``, ``network``) of any size.

    Distinct addresses are matched once, by equality on (prefix length, network), for the lengths that the table has, 33 at
    most; so neither side is broadcast and no range comparison is joined. An empty table allows all.
    """
    number = ip_number(F.col(column))
    lengths = ranges.where(F.col("prefix").isNotNull()).agg(F.collect_set(F.col("prefix").cast("int"))).scalar()
    listed = ranges.agg(F.count(F.lit(1))).scalar()
    addresses = connections.select(column).distinct().withColumn("_n", number).withColumn("_p", F.explode(lengths))
    spread = addresses.select(column, F.col("_p").alias("prefix"), network_of(F.col("_n"), F.col("_p")).alias("network"))
    known = ranges.select(F.col("prefix").cast("int").alias("prefix"), F.col("network").cast("long").alias("network")).distinct()
    inside = spread.join(known, ["prefix", "network"], "left_semi").select(column).distinct()
    out = null_safe_join(connections, inside.withColumn("_hit", F.lit(True)), [column])
    return out.withColumn("allowed", F.coalesce("_hit", F.lit(False)) | (listed == 0)).drop("_hit")


def orphans(resources: DataFrame, sessions: DataFrame, resource_key: str, session_key: str) -> DataFrame:
    """Resources no session owns."""
    owners = sessions.select(F.col(session_key).alias("_owner")).where(F.col("_owner").isNotNull()).distinct()
    return resources.join(owners, resources[resource_key] == owners["_owner"], "left_anti")
