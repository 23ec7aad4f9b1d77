"""Quality rules as a short-circuit cascade.

Every rule looks at many documents at once and says which pass. Before the run, each is timed and counted on a bounded
sample; the cascade then applies the rule that rejects most per second first, and each later rule only sees what is
left. The verdict is that all rules pass, so it does not depend on the order, the sample or the timing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.llm import textarrays as ta

Batches = Iterator[pa.RecordBatch]
Check = Callable[[np.ndarray, np.ndarray], np.ndarray]

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
WINDOW = 5


# --- measures, one value per document ---------------------------------------------------------------


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each document."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    _, _, doc = ta.words(data, offsets)
    return np.bincount(doc, minlength=len(offsets) - 1)


def word_chars(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points in words."""
    return per_document(~ta.SEPARATOR[data] & ((data & 0xC0) != 0x80), offsets)


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return per_document(_SYMBOL[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those among them that equal an earlier one."""
    docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    stop = np.append(start[1:], len(data))
    stop = stop - (data[stop - 1] == 10)
    filled = np.concatenate(([0], np.cumsum(~ta.SEPARATOR[data], dtype=np.int64)))
    some = filled[stop] > filled[start]
    start, stop = start[some], stop[some]
    doc = np.searchsorted(offsets, start, "right") - 1
    key = ta.mix(ta.span_hash(ta.prefix_hash(data), start, stop) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    again = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    return np.bincount(doc, minlength=docs), np.bincount(doc[order[again]], minlength=docs)


def repeated_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words that lie in a window of WINDOW words which the document holds more than once."""
    docs = len(offsets) - 1
    begins, ends, doc = ta.words(data, offsets)
    if not len(begins):
        return np.zeros(docs, np.int64)
    value, first = ta.shingles(ta.span_hash(ta.prefix_hash(data), begins, ends), doc, WINDOW)
    key = ta.mix(value + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(doc) + 1, np.int64)
    edge[first[twice]] += 1
    edge[first[twice] + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


# --- rules -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Check


def _few_words(least: int) -> Check:
    return lambda data, offsets: word_counts(data, offsets) >= least


def _repeats(percent: int) -> Check:
    return lambda data, offsets: 100 * repeated_words(data, offsets) <= percent * word_counts(data, offsets)


def _symbols(per_word: float) -> Check:
    return lambda data, offsets: symbols(data, offsets) <= per_word * word_counts(data, offsets)


def _word_length(low: float, high: float) -> Check:
    def check(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        chars, count = word_chars(data, offsets), word_counts(data, offsets)
        return (chars >= low * count) & (chars <= high * count)

    return check


def _duplicate_lines(share: float) -> Check:
    def check(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        some, again = lines(data, offsets)
        return again <= share * some

    return check


#: The production rules. A document without words fails the first.
RULES = (
    Rule("few_words", _few_words(10)),
    Rule("repeated_words", _repeats(20)),
    Rule("symbols", _symbols(0.5)),
    Rule("word_length", _word_length(2, 25)),
    Rule("duplicate_lines", _duplicate_lines(0.5)),
)


def select_documents(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of some documents of a chunk."""
    sizes = np.diff(offsets)
    mask = np.repeat(np.isin(np.arange(len(sizes)), chosen), sizes)
    return data[mask], np.concatenate(([0], np.cumsum(sizes[chosen])))


def cascade(data: np.ndarray, offsets: np.ndarray, rules: Sequence[Rule]) -> np.ndarray:
    """Which documents pass all rules; each rule sees only those that passed the ones before it."""
    left = np.arange(len(offsets) - 1)
    body, bounds = data, offsets
    for rule in rules:
        if not len(left):
            break
        good = np.flatnonzero(rule.passes(body, bounds))
        if len(good) < len(left):
            left = left[good]
            body, bounds = select_documents(body, bounds, good)
    out = np.zeros(len(offsets) - 1, bool)
    out[left] = True
    return out


def order_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejections per second, most first, as measured in a task on about `sample_rows` hashed documents."""
    rows = docs.count()
    cut = int(1_000_000 * min(1.0, sample_rows / rows)) if rows else 0
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < cut)

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            for _, _, data, offsets in ta.chunks(batch.column("text")):
                for number, rule in enumerate(rules):
                    began = time.perf_counter()
                    bad = int(np.count_nonzero(~rule.passes(data, offsets)))
                    yield pa.RecordBatch.from_pylist([{"rule": number, "seconds": time.perf_counter() - began, "rejected": bad}])

    told = sample.mapInArrow(measure, "rule long, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()
    rate = {r["rule"]: r["n"] / max(r["s"], 1e-9) for r in told}
    cost = {r["rule"]: r["s"] for r in told}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), cost.get(i, 0.0)))]


def filter_quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows whose text passes all rules, with all their columns. Null counts as empty.

    Every row is judged by itself: repeated rows fare alike, empty tables stay empty, other columns are carried along.
    """
    ordered = order_rules(docs, text_col, rules, sample_rows)
    place = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            kept = [cascade(data, offsets, ordered) for _, _, data, offsets in ta.chunks(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """Per row: `id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and kept: whether all rules pass."""
    ordered = order_rules(docs, text_col, rules, sample_rows)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, offsets in ta.chunks(batch.column(1)):
                measured = word_counts(data, offsets), word_chars(data, offsets), symbols(data, offsets), lines(data, offsets)[1], repeated_words(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(m.astype(np.int64)) for m in measured], pa.array(cascade(data, offsets, ordered))],
                    names=["doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, kept boolean")
    return out.withColumnRenamed("doc", id_col)
