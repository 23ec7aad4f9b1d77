"""Linear recurrences ``y[i] = a * y[i-1] + (1 - a) * x[i]`` over long series, several at once, parallel in time.

Inside a part of a chunk a recurrence has the closed form ``y[j] = a^j * (a * y_in + (1 - a) * sum(x a^-i))``, a running
sum in a window over (symbol, chunk, part). A part is at most ``chunk_rows`` rows by position, however dense the series
is in time. It hands on a few numbers: its rows, its first and last value, its own result for ``y_in = 0`` of every
recurrence, and a tail and head of values. The true ``y_in`` of a part folds the results of the parts before it, as far
back as their weight is above 0 as a double. A seed is a made-up value before the first row, which makes the recurrence
pass through the seed where it should. So one pass over the rows serves all recurrences, and moving averages too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlelake.operators.series import CANDLE_CHUNK_ROWS, CHUNK, chunk_window, chunked

#: The smallest double: the weight of anything further back is exactly 0.
SMALLEST = 5e-324
#: Largest power ``a^-i`` the running sum may reach.
MAX_POWER = 1e150


@dataclass(frozen=True)
class Smooth:
    """One recurrence: output name, factor ``a``, and the rows whose mean is the seed (0: the first value is).

    ``sign`` 0 smooths the values; 1 and -1 smooth the rises and falls from row to row, of which the first row has none.
    These come out divided by ``a^position``: only their ratio is of use, and it does not underflow that way.
    """

    name: str
    a: float
    seed: int = 0
    sign: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.a < 1:
            raise ValueError("the factor must be in [0, 1)")

    @property
    def head(self) -> int:
        return max(self.seed + abs(self.sign), 1)

    def power(self, n: Column) -> Column:
        return F.pow(F.lit(float(self.a)), n.cast("double")) if self.a else F.when(n == 0, 1.0).otherwise(0.0)

    def move(self, now: Column, before: Column) -> Column:
        return F.coalesce(F.greatest(self.sign * (now - before), F.lit(0.0)), F.lit(0.0))


def chunk_rows(a: float) -> int:
    """Rows a part may hold so that the running sum stays inside the range of a double."""
    if a <= 0:
        return 1
    return max(1, min(CANDLE_CHUNK_ROWS, int(math.log(MAX_POWER) / -math.log(a))))


def _ending(array: str, n: int | Column) -> Column:
    """The last n values of an array, or all of a shorter one."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def _start(s: Smooth, first: Column) -> Column:
    """The made-up value before the first row, from the array of a series' first values."""
    if not s.seed or not s.a:
        return F.element_at(first, 1) if not s.seed else F.lit(0.0)
    inputs = F.slice(first, 1, s.head)
    if s.sign:
        inputs = F.transform(F.slice(first, 2, s.seed), lambda x, i: s.move(x, F.get(first, i)))
    sums = F.aggregate(inputs, F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("y")), lambda acc, x: F.struct((acc["mean"] + x / s.seed).alias("mean"), (acc["y"] * s.a + x * (1 - s.a)).alias("y")))
    return F.when(F.size(first) >= s.head, (sums["mean"] - sums["y"]) / s.a**s.head).otherwise(0.0)


def smooth(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, recurrences: Sequence[Smooth], step_ms: int, means: Sequence[int] = ()) -> DataFrame:
    """Add a column per recurrence, ``idx`` (0-based position), and ``mean<n>`` of the last n values (NULL before).

    Chunks are as wide as a part's rows at one row per ``step_ms``; a denser series, as with copies, has several parts in
    a chunk. Rows without key or time are left out. Rises and falls also add ``_moved``: their shares (up, down) on the last part's row that had any. The rows
    are shuffled once, and what parts hand on twice.
    """
    size = min([chunk_rows(s.a) for s in recurrences], default=CANDLE_CHUNK_ROWS)
    tail = max(means, default=1) - 1
    head = max([s.head for s in recurrences], default=1)
    x = F.col(value).cast("double")
    # Said outright, the filter that the join below implies stands under both of its sides, and they share one shuffle.
    rows = chunked(df, order, step_ms * size)
    for c in (*keys, CHUNK):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.withColumn("_pos", F.row_number().over(chunk_window(keys, order)) - 1)
    rows = rows.withColumns({"_part": F.floor(F.col("_pos") / size).cast("int"), "_pos": (F.col("_pos") % size).cast("int")})
    part = [*keys, CHUNK, "_part"]
    ordered = Window.partitionBy(*part).orderBy("_pos")
    before = F.lag(x).over(ordered)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_before", before)
    sums = {}
    for s in recurrences:
        own = F.when(F.col("_before").isNull(), 0.0).otherwise(s.move(x, F.col("_before"))) if s.sign else x
        sums[f"_s_{s.name}"] = F.sum(own * (1 - s.a) * F.pow(F.lit(float(s.a or 1)), -F.col("_pos").cast("double"))).over(upto)
    for n in means:
        sums[f"_m_{n}"] = F.sum(x).over(ordered.rowsBetween(-(n - 1), 0))
    local = local.withColumns(sums).drop("_before")

    ends = local.groupBy(*part).agg(
        F.count("*").alias("_rows"),
        F.min_by(x, "_pos").alias("_first"),
        F.max_by(x, "_pos").alias("_last"),
        *[F.max_by(f"_s_{s.name}", "_pos").alias(f"_s_{s.name}") for s in recurrences],
        F.sort_array(F.collect_list(F.when(F.col("_pos") < head, F.struct("_pos", x.alias("x"))))).alias("_heads"),
        F.sort_array(F.collect_list(F.struct("_pos", x.alias("x")))).alias("_all") if tail else F.lit(None).alias("_all"),
    )
    in_order = Window.partitionBy(*keys).orderBy(CHUNK, "_part")
    ends = ends.withColumns({"_end": F.sum("_rows").over(in_order), "_prev": F.lag("_last").over(in_order), "_tail": _ending("_all.x", tail) if tail else F.lit(None)}).drop("_all")
    start = F.col("_end") - F.col("_rows")
    # The result of a part alone: its running sum, and for rises and falls the step from the part before.
    for s in recurrences:
        step = s.move(F.col("_first"), F.col("_prev")) * (1 - s.a) if s.sign else F.lit(0.0)
        ends = ends.withColumns({f"_x_{s.name}": step, f"_y_{s.name}": s.power(F.col("_rows") - 1) * (F.col(f"_s_{s.name}") + step)})
    reach = max([math.ceil(math.log(SMALLEST) / math.log(s.a)) for s in recurrences if s.a], default=0) + size
    near = Window.partitionBy(*keys).orderBy("_end").rangeBetween(-reach, -1)
    known = {
        "_parts": F.collect_list(F.struct("_end", *[f"_y_{s.name}" for s in recurrences])).over(near),
        "_begin": F.flatten(F.transform(F.array_sort(F.collect_list(F.when(start < head, F.struct(start.alias("s"), F.col("_heads.x").alias("x")))).over(Window.partitionBy(*keys))), lambda h: h["x"])),
        "_start": start,
    }
    if tail:
        close = Window.partitionBy(*keys).orderBy("_end").rangeBetween(-(tail + size), -1)
        known["_tails"] = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_end", "_tail")).over(close)), lambda t: t["_tail"]))
    ends = ends.withColumns(known)

    def fold(s: Smooth) -> Column:
        seeded = _start(s, F.slice("_begin", 1, s.head)) * s.power(F.col("_start"))
        return F.aggregate("_parts", seeded, lambda acc, p: acc + p[f"_y_{s.name}"] * s.power(F.col("_start") - p["_end"]))

    carried = [F.col("_part").alias("part"), F.col("_start").alias("start")]
    moves = [s for s in recurrences if s.sign]
    ends = ends.withColumns({f"_in_{s.name}": fold(s) * s.a + F.col(f"_x_{s.name}") for s in recurrences})
    if moves:
        total = [F.col(f"_in_{s.name}") + F.col(f"_s_{s.name}") for s in moves]
        some = F.when(total[0] + total[1] > 0, F.struct((total[0] / (total[0] + total[1])).alias("up"), (total[1] / (total[0] + total[1])).alias("down")))
        carried.append(F.last(some, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("moved"))
    carried += [F.col(f"_in_{s.name}").alias(f"in_{s.name}") for s in recurrences]
    carried += [_ending("_tails", tail).alias("tail")] if tail else []
    carry = ends.select(*keys, CHUNK, F.struct(*carried).alias("_c")).groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list("_c")).alias("_carry"))

    out = local.join(carry, [*keys, CHUNK]).withColumn("_c", F.get("_carry", F.col("_part"))).drop("_carry")
    pos = F.col("_pos")
    found = {"idx": F.col("_c.start") + pos}
    for s in recurrences:
        whole = F.col(f"_c.in_{s.name}") + F.col(f"_s_{s.name}")
        found[s.name] = whole if s.sign else s.power(pos) * whole if s.a else x
    if moves:
        found["_moved"] = F.col("_c.moved")
    for n in means:
        lent = F.when(pos < n - 1, F.aggregate(_ending("_c.tail", n - 1 - pos), F.lit(0.0), lambda acc, v: acc + v)).otherwise(0.0)
        found[f"mean{n}"] = F.when(F.col("_c.start") + pos >= n - 1, (F.col(f"_m_{n}") + lent) / n)
    return out.withColumns(found).drop("_c", "_pos", "_part", CHUNK, *sums)
