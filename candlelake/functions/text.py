"""Text functions for symbols and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlelake.schemas import SYMBOL_PATTERN

# Quote assets a pair may end with, in the order they are tried, and those that are
# written out in a display name.
BASE_SUFFIXES = ["USDT", "BUSD", "USDC", "BTC", "ETH", "BNB"]
DISPLAY_SUFFIXES = ["USDT", "BTC"]
BLANKS = " \t\n\r\f\v"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: str | Column) -> Column:
    """Remove blanks, tabs and line ends on both sides."""
    return F.trim(_c(text), F.lit(BLANKS))


def clean_symbol(text: str | Column) -> Column:
    return F.upper(strip(text))


def is_symbol(text: str | Column) -> Column:
    """True where a cleaned symbol is well formed."""
    return _c(text).rlike(rf"\A{SYMBOL_PATTERN}\z")


def display_name(symbol: str | Column) -> Column:
    """``BTCUSDT`` -> ``BTC / USDT``; a pair with another quote asset is shown as it is."""
    symbol = _c(symbol)
    out = symbol
    for quote in reversed(DISPLAY_SUFFIXES):
        base = F.substring(symbol, F.lit(1), F.length(symbol) - len(quote))
        out = F.when(symbol.endswith(quote), F.concat(base, F.lit(f" / {quote}"))).otherwise(out)
    return out


def base_coin(symbol: str | Column) -> Column:
    """Pair without its quote asset; the pair itself if nothing would be left."""
    symbol = _c(symbol)
    base = F.regexp_extract(symbol, f"^(.+?)({'|'.join(BASE_SUFFIXES)})$", 1)
    return F.when(base != "", base).otherwise(symbol)


def key_partition(key: str | Column, partitions: int = 12) -> Column:
    """md5 of the key, read as one big number, modulo the partition count.

    The 128-bit number is reduced in four 32-bit pieces, so the work stays in BIGINT arithmetic.
    """
    digest = F.md5(_c(key).cast("binary"))
    step = F.lit(2**32 % partitions).cast("bigint")
    out = F.lit(0).cast("bigint")
    for i in range(4):
        piece = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        out = F.pmod(out * step + piece, F.lit(partitions).cast("bigint"))
    return out.cast("int")
