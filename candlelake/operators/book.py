"""Order books: rows with ``bids`` and ``asks`` as arrays of (price, qty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlelake.functions.numeric import rounded
from candlelake.schemas import LEVELS_DDL


def parse_levels(text: str | Column) -> Column:
    """Price levels from ``[[price, qty], ...]`` JSON; numbers may be written as text."""
    raw = F.from_json(text, "array<array<string>>")
    levels = F.transform(
        raw,
        lambda x: F.struct(
            F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")
        ),
    )
    return F.coalesce(levels, F.array().cast(LEVELS_DDL))


def levels_json(levels: str | Column) -> Column:
    """``[[price,qty],...]`` JSON of price levels."""
    return F.to_json(F.transform(levels, lambda x: F.array(x["price"], x["qty"])))


def _best(side: str) -> Column:
    return F.get(F.col(side), F.lit(0))["price"]


def book_metrics(df: DataFrame) -> DataFrame:
    """Add depth counts, best prices and the spread; 0 where a side is empty."""
    both = (F.size("bids") > 0) & (F.size("asks") > 0)
    return df.withColumns(
        {
            "bid_depth": F.size("bids"),
            "ask_depth": F.size("asks"),
            "best_bid": F.coalesce(_best("bids"), F.lit(0.0)),
            "best_ask": F.coalesce(_best("asks"), F.lit(0.0)),
            "spread": F.when(both, F.round(_best("asks") - _best("bids"), 8)).otherwise(0.0),
        }
    )


#: Levels added up in one list; deeper books are added up block by block, since a list is copied as it grows.
LEVEL_BLOCK = 32


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _with_totals(levels: str, level: T.DataType) -> Column:
    """Each level of a side beside the running quantity up to it, in one pass from the first level to the last."""
    row = T.StructType([T.StructField("x", level), T.StructField("total", T.DoubleType())])
    none, no_blocks = F.array().cast(T.ArrayType(row)), F.array().cast(T.ArrayType(T.ArrayType(row)))

    def ladder(part: Column, start: Column) -> Column:
        def step(done: Column, x: Column) -> Column:
            before = F.when(F.size(done) == 0, start).otherwise(_last(done)["total"])
            return F.array_append(done, F.struct(x.alias("x"), (before + x["qty"]).alias("total")))

        return F.aggregate(part, none, step)

    def next_block(done: Column, block: Column) -> Column:
        before = F.when(F.size(done) == 0, 0.0).otherwise(_last(_last(done))["total"])
        return F.array_append(done, ladder(block, before))

    starts = F.sequence(F.lit(1), F.greatest(F.size(levels), F.lit(1)), F.lit(LEVEL_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(levels, i, LEVEL_BLOCK))
    deep = F.flatten(F.aggregate(blocks, no_blocks, next_block))
    return F.when(F.size(levels) <= LEVEL_BLOCK, ladder(F.col(levels), F.lit(0.0))).otherwise(deep)


def book_ladder(df: DataFrame, *keys: str) -> DataFrame:
    """One row per level: running total, bar length in percent of the side's total, spread percent.

    A book lives in one row, so the running totals are taken inside the array and nothing is shuffled. A level takes its
    own total along, not the whole array. Totals are added from the first level on, in that order.
    """
    ask, bid = _best("asks"), _best("bids")
    quoted = F.when(ask.isNotNull() & bid.isNotNull() & (ask != 0), (ask - bid) / ask * 100).otherwise(0.0)
    summed = df.select(*keys, quoted.alias("_spread"), *[_with_totals(c, df.schema[c].dataType.elementType).alias(c) for c in ("bids", "asks")])
    # The sides are exploded with their totals: totals of an exploded side would be taken again by the filter Spark adds on its size.
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(c).alias("levels")) for name, c in (("bid", "bids"), ("ask", "asks"))])
    parts = summed.select(*keys, "_spread", F.explode(sides).alias("_s")).select(*keys, "_spread", "_s.*")
    known = parts.select("*", _last(F.col("levels"))["total"].alias("_whole"))
    rows = known.select(
        *keys, rounded("_spread", 3).alias("spread_pct"), "side", rounded("_whole", 4).alias("_whole"), F.posexplode("levels").alias("level", "_l")
    )
    totals = rows.select("*", rounded("_l.total", 4).alias("total"))
    share = F.col("total") / F.when(F.col("_whole") == 0, 1.0).otherwise(F.col("_whole")) * 100
    return totals.select("*", share.alias("_share")).select(
        *keys,
        "side",
        "level",
        "_l.x.price",
        rounded("_l.x.qty", 4).alias("amount"),
        "total",
        rounded("_share", 4).alias("bar_pct"),
        "spread_pct",
    )


def book_or_ticker(book: DataFrame, ticker: DataFrame) -> DataFrame:
    """The book of each symbol; where there is none, a one-level book from the ticker's bid and ask."""
    columns = ["bids", "asks", "spread", "best_bid", "best_ask", "event_time"]
    books = book.select("symbol", F.struct(*columns).alias("_book"))
    quoted = ticker.where((F.col("bid") > 0) & (F.col("ask") > 0))

    def level(side: str) -> Column:
        return F.array(F.struct(F.col(side).alias("price"), F.lit(0.0).alias("qty")))

    quotes = quoted.select(
        "symbol",
        F.struct(
            level("bid").alias("bids"),
            level("ask").alias("asks"),
            F.round(F.col("ask") - F.col("bid"), 8).alias("spread"),
            F.col("bid").alias("best_bid"),
            F.col("ask").alias("best_ask"),
            "event_time",
        ).alias("_quote"),
    )
    return books.join(quotes, "symbol", "full").select("symbol", F.coalesce("_book", "_quote").alias("_b")).select("symbol", "_b.*")
