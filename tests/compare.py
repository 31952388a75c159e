"""Run registered queries next to their SQL twins and compare row values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkguard.plans.registry import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith("decimal"):
        return "decimal"
    for group, names in {
        "int": ("bigint", "integer", "int", "smallint", "tinyint", "hugeint", "long"),
        "float": ("double", "float"),
        "string": ("varchar", "string"),
        "time": ("timestamp", "timestamp_ntz"),
    }.items():
        if t in names:
            return group
    return t


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, sf_dir, key, build, sql):
    """Returns (ok, text)."""
    t = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t
    if sql is None:
        return True, f"rows {len(got)} ({t_spark:.1f}s, no twin)"
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    t_duck = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    diff = {c: (kind(d), types[c]) for c, d in df.dtypes if kind(d) != types[c]}
    if diff:
        return False, f"types differ (spark, duckdb) {diff}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (
            f"rows {len(a)} / {len(b)}; columns {sorted(names)}\n   only spark {list(sa - sb)[:3]}\n   only duckdb {list(sb - sa)[:3]}"
        )
    return True, f"rows {len(a)} spark {t_spark:.1f}s duckdb {t_duck:.1f}s" + ("  EMPTY" if not a else "")


def main(argv):
    import __spark_entry__ as entry
    from sparkguard.session import local_session

    sf = next((a[5:] for a in argv if a.startswith("--sf=")), "/root/testdata/sf0.01")
    pick = [a for a in argv if not a.startswith("--")]
    spark = local_session("8")
    con = connect(sf)
    twins, bad = entry.oracle_sql(), []
    for key, build in entry.queries().items():
        if pick and not any(p == key or (p.endswith("*") and key.startswith(p[:-1])) for p in pick):
            continue
        try:
            ok, text = compare(spark, con, sf, key, build, twins.get(key))
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:900]}"
        if not ok:
            bad.append(key)
        if not ok or "--quiet" not in argv or "EMPTY" in text:
            print(("ok   " if ok else "FAIL ") + key, text, flush=True)
    print(len(bad), "failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
