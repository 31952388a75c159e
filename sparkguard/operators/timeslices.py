"""Time-ordered work on series of any length.

A window over one whole series would put a hot series into one task. Here a series is cut into slices
of time; each slice is one group, and what a slice needs from earlier ones is handed on as one small
row per slice (its last row, its sum, its state), or as copies of the rows that a window looks back on.

A slice that holds too many rows is cut further, by counts: rows are counted in CELLS cells of the slice's time, and every so many rows a new
piece begins. So however rows are spread over time, a group has about PIECE_ROWS rows, or one in MOST_PIECES of what hot slices hold where that is
more. Only rows of one cell (a millionth of a slice) stay together. One small job counts rows per slice when the operator is called; where no slice
is hot, the plan has nothing of all this. Results are the same in either case.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.operators.joining import null_safe_join

# Width of a slice: a series has one small row per hour, and more where an hour is cut.
SLICE_SECONDS = 3_600
# Rows of a piece, cells of a slice's time, and pieces of hot slices at most.
PIECE_ROWS, CELLS, MOST_PIECES = 1_000_000, 1 << 20, 5_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def _whole_steps(us: Column, step: int) -> Column:
    """Floor of ``us / step`` in whole numbers."""
    return ((us - F.pmod(us, F.lit(step))) / F.lit(step)).cast("long")


def time_slice(ts: str, seconds: int) -> Column:
    return _whole_steps(micros(F.col(ts)), seconds * 1_000_000)


def borders_of(groups: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """Where pieces begin (``_borders``, cells) in the slices that have more than ``most`` rows, or None if none has.

    ``groups`` has a row's key, ``_slice`` and ``_cell``. The result is a local table of MOST_PIECES rows at most; beyond as many slices, the smaller ones
    are left whole.
    """
    spark, slices = groups.sparkSession, [*keys, "_slice"]
    sizes = groups.groupBy(*slices).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    hot = sizes.orderBy(F.desc("_n")).limit(MOST_PIECES).collect()
    if not hot:
        return None
    bound = max(most, sum(r["_n"] for r in hot) // MOST_PIECES)
    names = spark.createDataFrame([tuple(r)[:-1] for r in hot], sizes.select(*slices).schema)
    cells = null_safe_join(groups, F.broadcast(names), slices, "inner").groupBy(*slices, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*slices).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    begun = cells.withColumn("_piece", F.floor(F.coalesce(before, F.lit(0)) / bound)).groupBy(*slices, "_piece").agg(F.min("_cell").alias("_from"))
    found = begun.groupBy(*slices).agg(F.array_sort(F.collect_list("_from")).alias("_borders"))
    return spark.createDataFrame([tuple(r) for r in found.collect()], found.schema)


def cell(us: Column, length: int) -> Column:
    """A time's cell in its slice, which is ``length`` microseconds wide."""
    return F.floor(F.pmod(us, F.lit(length)) * F.lit(CELLS / length)).cast("int")


def cut(placed: DataFrame, keys: list[str], borders: DataFrame | None, how: str = "left") -> DataFrame:
    """Replaces ``_slice`` and ``_cell`` by ``_g``, the group of a row: its key, slice and piece, as one value that is never null.

    With ``how`` "inner" only the rows of slices that are cut.
    """
    columns = [c for c in placed.columns if c not in ("_slice", "_cell")]
    piece = F.lit(0)
    if borders is not None:
        placed = null_safe_join(placed, F.broadcast(borders), [*keys, "_slice"], how)
        # With a null list of borders, size() is -1 or null: no piece but the first.
        piece = F.greatest(F.size(F.filter("_borders", lambda b: b <= F.col("_cell"))), F.lit(0))
    return placed.select(*columns, F.struct(*[F.col(k) for k in keys], "_slice", piece.alias("_piece")).alias("_g"))


def _sliced(df: DataFrame, keys: list[str], ts: str, seconds: int, most: int) -> DataFrame:
    placed = df.withColumns({"_slice": time_slice(ts, seconds), "_cell": cell(micros(F.col(ts)), seconds * 1_000_000)})
    return cut(placed, keys, borders_of(placed.select(*keys, "_slice", "_cell"), keys, most))


ROLLING = ("count", "sum", "avg", "min", "max", "stddev")


def _merged(parts: list[dict[str, Column]], wanted: tuple[str, ...]) -> dict[str, Column]:
    """Statistics of the rows of all parts together; a part without rows counts as nothing."""

    def added(name: str) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(p[name], F.lit(0)) for p in parts])

    count = added("count")
    filled = F.nullif(count, F.lit(0))
    out = {"count": count}
    if {"sum", "avg", "stddev"} & set(wanted):
        out["sum"] = F.when(count > 0, added("sum"))
        mean = out["sum"] / filled
        out["avg"] = mean
    if "min" in wanted:
        out["min"] = F.least(*[p["min"] for p in parts])
    if "max" in wanted:
        out["max"] = F.greatest(*[p["max"] for p in parts])
    if "stddev" in wanted:
        squares = [F.when(p["count"] > 0, p["squares"] + p["count"] * (p["sum"] / p["count"] - mean) ** 2).otherwise(0.0) for p in parts]
        squares = [F.coalesce(x, F.lit(0.0)) for x in squares]
        out["stddev"] = F.sqrt(reduce(lambda a, b: a + b, squares) / filled)
    return out


def rolling(
    df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, wanted: tuple[str, ...] = ROLLING, most: int = PIECE_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Statistics of ``value`` over the half-open window ``(ts - seconds, ts]`` at every row.

    Time is cut into blocks as long as the window, so a window is the end of one block and the start of
    the next. Each row is also shown to the block after its own. There, the start is a running aggregate
    in time order, and the end a running aggregate in reverse order, read at ``ts - seconds``. Every
    aggregate grows by one row at a time however many rows a window holds.

    Both aggregates are mergeable. Where a block is cut into pieces, each piece runs its own, and gets what the pieces before it (of the start) and
    after it (of the end) come to as one row. Shown rows and a window's lower end have the same place in their block, so one cut serves both.
    ``counted`` may name a cheaper table with the same keys and times, in which rows are counted for the cut.
    """
    length = seconds * 1_000_000
    us = micros(F.col(ts))
    block = _whole_steps(us, length)
    shown = F.array(
        F.struct(F.lit(True).alias("own"), block.alias("block")), F.struct(F.lit(False).alias("own"), (block + 1).alias("block"))
    )
    def spread(rows: DataFrame) -> DataFrame:
        timed = rows.withColumn("_us", us).withColumn("_c", F.explode(shown))
        return timed.withColumns({"_own": F.col("_c.own"), "_slice": F.col("_c.block"), "_cell": cell(F.col("_us"), length)}).drop("_c")

    placed = spread(df)
    borders = borders_of(spread((df if counted is None else counted).select(*keys, ts)).select(*keys, "_slice", "_cell"), keys, most)
    rows = cut(placed, keys, borders)
    rows = rows.withColumn("_back", F.when(F.col("_own"), F.col("_us") - length).otherwise(F.col("_us")))
    own, v = F.col("_own"), F.col(value)
    need = ["count"] + ["sum"] * bool({"sum", "avg", "stddev"} & set(wanted)) + [n for n in ("min", "max") if n in wanted] + ["squares"] * ("stddev" in wanted)
    functions = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}

    def statistic(name: str, c: Column, over: Callable[[Column], Column] = lambda x: x) -> Column:
        return over(F.var_pop(c)) * over(F.count(c)) if name == "squares" else over(functions[name](c))

    sides = {"a": F.when(own, v), "b": F.when(~own, v)}
    start = W.partitionBy("_g").orderBy("_us").rangeBetween(W.unboundedPreceding, 0)
    end = W.partitionBy("_g").orderBy(F.desc("_back"), F.desc("_own")).rowsBetween(W.unboundedPreceding, 0)
    spans = {"a": lambda x: x.over(start), "b": lambda x: x.over(end)}
    local = [statistic(n, c, spans[s]).alias(f"_{s}_{n}") for s, c in sides.items() for n in need]
    both = rows.select("*", *local).where("_own")
    if borders is not None:
        # What the pieces of a block come to, and what those before (of its start) and after (of its end) come to.
        pieces = cut(placed, keys, borders, "inner").groupBy("_g").agg(*[statistic(n, c).alias(f"_{s}_{n}") for s, c in sides.items() for n in need])
        both = both.join(F.broadcast(_carried(pieces, keys, need)), F.col("_g") == F.col("_h"), "left")
    out = _merged([{n: F.col(f"{p}_{s}_{n}") for n in need} for p in ("", "_of")[: 1 + (borders is not None)] for s in sides], wanted)
    return both.select(*df.columns, *[out[n].alias(n) for n in wanted])


def _carried(pieces: DataFrame, keys: list[str], need: list[str]) -> DataFrame:
    """Per piece (``_h``) what the pieces before it have of ``a`` and those after it of ``b``.

    Squares are taken about the mean of the whole block, so that little cancels when they are put together.
    """
    block = W.partitionBy(*[F.col(f"_g.{k}") for k in keys], F.col("_g._slice"))
    plain = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    columns = [F.col("_g").alias("_h")]
    for s, order in (("a", F.col("_g._piece")), ("b", F.desc("_g._piece"))):
        others = block.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        columns += [plain[n](f"_{s}_{n}").over(others).alias(f"_of_{s}_{n}") for n in need if n in plain]
        if "squares" in need:
            n, total = F.col(f"_{s}_count"), F.col(f"_{s}_sum")
            centre = F.sum(total).over(block) / F.nullif(F.sum(n).over(block), F.lit(0))
            pieces = pieces.withColumn(f"_{s}_centre", centre)
            about = F.when(n > 0, F.col(f"_{s}_squares") + n * (total / n - F.col(f"_{s}_centre")) ** 2)
            pieces = pieces.withColumn(f"_{s}_about", about)
            apart = F.sum(total).over(others) / F.nullif(F.sum(n).over(others), F.lit(0)) - F.col(f"_{s}_centre")
            columns.append(F.greatest(F.lit(0.0), F.sum(f"_{s}_about").over(others) - F.sum(n).over(others) * apart * apart).alias(f"_of_{s}_squares"))
    return pieces.select(*columns)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], slice_seconds: int = SLICE_SECONDS, most: int = PIECE_ROWS) -> DataFrame:
    """Adds ``prev_<column>`` from the row before within the key; ``order`` starts with the time."""
    packed = F.struct(*[F.col(c) for c in columns])
    sliced = _sliced(df, keys, order[0], slice_seconds, most)
    inside = sliced.withColumn("_prev", F.lag(packed).over(W.partitionBy("_g").orderBy(*order)))
    tails = sliced.groupBy("_g").agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = tails.select(F.col("_g").alias("_h"), F.lag("_tail").over(_slices(keys)).alias("_carry"))
    out = inside.join(carried, F.col("_g") == F.col("_h"), "left")
    prev = F.coalesce("_prev", "_carry")
    return out.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def _slices(keys: list[str]) -> WindowSpec:
    """The pieces of a key in order: one small row each."""
    return W.partitionBy(*[F.col(f"_g.{k}") for k in keys]).orderBy(F.col("_g._slice"), F.col("_g._piece"))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str, slice_seconds: int = SLICE_SECONDS, most: int = PIECE_ROWS) -> DataFrame:
    """Adds the sum of ``amount`` up to and including the row within the key."""
    sliced = _sliced(df, keys, order[0], slice_seconds, most).withColumn("_amount", amount)
    window = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = sliced.withColumn("_inside", F.sum("_amount").over(window))
    sums = sliced.groupBy("_g").agg(F.sum("_amount").alias("_s"))
    earlier = _slices(keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("_g").alias("_h"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_offset"))
    out = inside.join(offsets, F.col("_g") == F.col("_h"), "left")
    return out.select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(name))


def with_run(df: DataFrame, keys: list[str], order: list[str], state: str, slice_seconds: int = SLICE_SECONDS, most: int = PIECE_ROWS) -> DataFrame:
    """Numbers the runs of equal ``state`` within a key as ``run`` (1, 2, ...).

    Changes are counted inside each slice; a slice hands on its first and last state and its count.
    """
    sliced = _sliced(df, keys, order[0], slice_seconds, most)
    rows = W.partitionBy("_g").orderBy(*order)
    changed = F.when((F.row_number().over(rows) == 1) | F.col(state).eqNullSafe(F.lag(state).over(rows)), 0).otherwise(1)
    inside = sliced.withColumn("_changed", changed).withColumn("_local", F.sum("_changed").over(rows.rowsBetween(W.unboundedPreceding, 0)))
    by_time = F.struct(*order)
    ends = inside.groupBy("_g").agg(
        F.min_by(F.struct(state), by_time).alias("_first"), F.max_by(F.struct(state), by_time).alias("_last"), F.sum("_changed").alias("_n")
    )
    slices = _slices(keys)
    joins = ends.withColumn("_new", F.when(F.col("_first").eqNullSafe(F.lag("_last").over(slices)), 0).otherwise(1))
    upto = F.sum("_new").over(slices.rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_n").over(slices.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = joins.select(F.col("_g").alias("_h"), (upto + before).alias("_offset"))
    out = inside.join(offsets, F.col("_g") == F.col("_h"), "left")
    return out.select(*df.columns, (F.col("_offset") + F.col("_local")).alias("run"))


def first_and_last_slot(seconds: int, period: int | Column, ts: Column) -> tuple[Column, Column]:
    """Numbers of the first and last grid time (multiples of ``seconds``) whose closed look-back of ``period`` seconds holds ``ts``."""
    step = seconds * 1_000_000
    span = (period if isinstance(period, Column) else F.lit(period)).cast("long") * 1_000_000
    return _whole_steps(micros(ts) + F.lit(step - 1), step), _whole_steps(micros(ts) + span, step)


def slots(seconds: int, period: int, ts: Column) -> Column:
    """Grid times (epoch seconds) whose closed look-back of ``period`` holds ``ts``."""
    first, last = first_and_last_slot(seconds, period, ts)
    span = F.sequence(first, last)
    return F.transform(F.when(first <= last, span).otherwise(F.array().cast("array<bigint>")), lambda i: i * seconds)
