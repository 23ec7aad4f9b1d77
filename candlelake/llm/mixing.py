"""Mixing sources to target weights along a time-varying curriculum, on DataFrame functions alone.

A source's target is its share of all words, but at most `max_repeats` times its own size; what a capped source leaves
goes to the others by weight. Its documents form a stream in a fixed pseudo-random order, read as often as the target
needs. The weight schedule of a source, integrated over training time, gives the words it has delivered by any moment;
the inverse of that curve turns a place in the stream into a training position between 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from candlelake.llm.shared import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a document's hash that number its slice; a source is summed slice by slice.
SLICE_DIGITS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


Weight = float | tuple[float, float, float]


def cycle_weights(sources: DataFrame, source_col: str, weights: list[Weight]) -> DataFrame:
    """Weights dealt to the distinct sources in code point order, null last, repeating. One row per source.

    A weight is a number, or (weight, start, end) with its relative height at the start and the end of training.
    """
    full = [w if isinstance(w, tuple) else (w, 1.0, 1.0) for w in weights]
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.select(source_col).distinct().select(
        source_col, *[F.element_at(F.array(*[F.lit(float(w[i])) for w in full]), turn + 1).alias(n) for i, n in enumerate(("weight", "start", "end"))]
    )


def source_targets(sizes: DataFrame, max_repeats: float = 3.0) -> DataFrame:
    """Adds `target` to rows of (source_size, weight): a share of all words by weight, none above its cap.

    With caps c and weights w the targets are min(c, x * w) for the one x that makes them add up. Sources are taken by
    c / w; x is found where the capped ones so far and the rest at x fit the total. Sources of size 0 or weight 0 get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_repeats))
    ready = sizes.withColumns({"__cap": F.when(F.col("weight") > 0, cap).otherwise(0.0), "__level": F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(0.0)})
    every = Window.partitionBy()
    upto = Window.orderBy("__level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col("source_size")).over(every)
    summed = ready.withColumns({"__total": total, "__capped": F.sum("__cap").over(upto), "__weights": F.sum("weight").over(every) - F.sum("weight").over(upto)})
    # A source is capped if everything up to its level, with the others at that level, still fits the total.
    summed = summed.withColumn("__full", F.col("__capped") + F.col("__level") * F.col("__weights") <= F.col("__total"))
    taken = F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0.0))
    left = F.coalesce(F.sum(F.when(~F.col("__full"), F.col("weight"))).over(every), F.lit(0.0))
    share = (F.col("__total") - taken) * F.col("weight") / left
    return summed.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(F.col("__cap"), share))).select(*sizes.columns, "target")


def training_time(done: Column, start: Column, end: Column) -> Column:
    """When a source has delivered the fraction `done` of its words, if its weight goes evenly from `start` to `end`.

    The integral to time t is start * t + (end - start) * t**2 / 2, divided by its value at 1; this is its inverse.
    """
    slope = end - start
    whole = (start + end) / 2
    root = F.sqrt(F.greatest(start * start + 2 * slope * done * whole, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, done).otherwise((root - start) / slope)


def plan_mix(docs: DataFrame, weights: DataFrame | list[Weight], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3) -> DataFrame:
    """How often, and when in training, each document is read.

    `weights` is a list dealt to the sources in code point order (null last), or a table (source, weight) with optional
    columns start and end, the relative weight at the start and the end of training (1 and 1: constant). Sources missing
    from the table weigh 0. Returns one row per input row: id, source, size (words), source_size, target, taken (words
    read, repeats counted), readings (position: training time in [0, 1); words: how many of its first words are read).

    The last round covers the front of the source's order up to the target; its last document is read in part, so a source
    meets its target to a word (equal rows share a part evenly), and no document is read more than `max_repeats`
    times. The order is that of a hash of id, source and text, so reruns agree; rows that are equal in all three are one
    unit, read alike. Null texts have size 0; empty documents are never read. Eager: tables are written to the shared
    folder.
    """
    if max_repeats < 1:
        raise ValueError("max_repeats must be 1 or more")
    slim = keep(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size"), order_key(id_col, text_col, source_col).alias("__key")))
    units = _place(slim, weights, source_col, max_repeats)
    return slim.select("__id", "__key").join(units, "__key").select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), "size", "source_size", "target", "taken", "readings")


def order_key(id_col: str, text_col: str, source_col: str) -> Column:
    """The place of a document in the pseudo-random order of its source, as hex digits."""
    source = F.col(source_col).cast("string")
    parts = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)), F.coalesce(F.col(text_col), F.lit(""))
    return F.md5(F.concat_ws("\n", *parts))


def _place(slim: DataFrame, weights: DataFrame | list[Weight], source_col: str, max_repeats: int) -> DataFrame:
    """One row per unit: __key, __source, size, source_size, target, taken, readings."""
    sizes = slim.groupBy("__source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, list):
        dealt = cycle_weights(sizes, "__source", weights)
    else:
        dealt = weights.withColumnRenamed(source_col, "__source")
    for name in ("start", "end"):
        if name not in dealt.columns:
            dealt = dealt.withColumn(name, F.lit(1.0))
    dealt = dealt.select(F.col("__source").alias("__s"), "weight", "start", "end")
    known = sizes.join(dealt, F.col("__source").eqNullSafe(F.col("__s")), "left").select("__source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("start", F.lit(1.0)).alias("start"), F.coalesce("end", F.lit(1.0)).alias("end"))
    plan = keep(source_targets(known, max_repeats)).select(F.col("__source").alias("__p"), "source_size", "target", "start", "end")

    units = slim.groupBy("__source", "__key").agg(F.first("size").alias("size"), F.count("*").alias("__n"))
    units = keep(units.withColumns({"__slice": F.substring("__key", 1, SLICE_DIGITS), "__words": F.col("size") * F.col("__n")}))
    slices = units.groupBy("__source", "__slice").agg(F.sum("__words").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("__source").alias("__b"), F.col("__slice").alias("__c"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__source", "__slice").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("__inside", F.coalesce(F.sum("__words").over(inside), F.lit(0)))
    placed = placed.join(slices, F.col("__source").eqNullSafe(F.col("__b")) & (F.col("__slice") == F.col("__c")))
    placed = placed.join(plan, F.col("__source").eqNullSafe(F.col("__p"))).withColumn("__at", F.col("__before") + F.col("__inside"))

    size, whole = F.col("source_size").cast("double"), F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    rounds = F.least(whole, F.lit(max_repeats))
    rest = F.floor(F.greatest(F.col("target") - rounds * size, F.lit(0.0))) - F.col("__at")
    extra = F.when(rounds < max_repeats, F.floor(F.greatest(F.least(rest, F.col("__words")), F.lit(0)) / F.col("__n"))).otherwise(0).cast("long")
    copies = F.when(F.col("size") > 0, rounds + F.when(extra > 0, 1).otherwise(0)).otherwise(0).cast("int")
    reach = F.greatest(F.col("target"), F.lit(1.0))
    done = lambda i: F.least((F.col("__at") + i * size) / reach, F.lit(1.0))
    placed = placed.withColumns({"__rounds": rounds, "__extra": extra})
    words = lambda i: F.when(i < F.col("__rounds"), F.col("size")).otherwise(F.col("__extra"))
    places = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda i: F.struct(training_time(done(i), F.col("start"), F.col("end")).alias("position"), words(i).alias("words")))
    taken = F.when(F.col("size") > 0, F.col("__rounds") * F.col("size") + F.col("__extra")).otherwise(0).cast("long").alias("taken")
    return placed.select("__key", "__source", "size", "source_size", "target", taken, F.slice(places, 1, copies).alias("readings"))


def mix_documents(docs: DataFrame, weights: DataFrame | list[Weight], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3) -> DataFrame:
    """The training stream: one row per reading, with the document's columns and `position`, range-sorted by position.

    `words` is how many of its first words this reading takes; see `plan_mix`. Input columns called position or words are
    replaced.
    """
    own = [c for c in docs.columns if c not in ("position", "words")]
    keyed = docs.select(own).withColumn("__key", order_key(id_col, text_col, source_col))
    slim = keep(keyed.select(F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size"), "__key"))
    units = _place(slim, weights, source_col, max_repeats).select("__key", F.col("readings").alias("__readings"))
    return keyed.join(units.filter(F.size("__readings") > 0), "__key").select(*own, F.inline("__readings")).sort("position", id_col)
