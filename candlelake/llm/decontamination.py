"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Every run of `segment` characters of an item is a segment, whatever character it starts at, so part of an item is enough
to be found wherever it was cut. A segment of m characters within k edits of a passage shares at least
m + 1 - (k + 1) * q of its q-grams with it, on diagonals (place in the document minus place in the item) that drift by k
at most; short items take a smaller q, which keeps that bound above 0. Hits are counted first by place, then per document
and item in diagonal bands that overlap by half, then per segment; only segments that reach the bound are aligned, and
those that stand in the document as they are need no alignment. The count can only be too high, so the filter loses
nothing.

Text is compared in lower case with every run of white space as one space. The benchmark is the query set: it is taken
in blocks of about `block_chars` characters, each a broadcast variable of some 30 bytes a character, and documents stream
past, once for every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.llm import textarrays as ta

Batches = Iterator[pa.RecordBatch]

_SPACES = np.zeros(0x3001, bool)
_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x10000)], np.uint32)
_TABLE_BITS = 20
_COST = 1 << 32
#: Stands for places outside a document; no character is equal to it.
_OUTSIDE = np.uint32(0xFFFFFFFF)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk, and the bounds of its documents in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, before[offsets]


def normalised(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points with single spaces, their places in the input, and the new bounds."""
    space = np.zeros(len(points), bool)
    low = points < len(_SPACES)
    space[low] = _SPACES[points[low]]
    again = np.zeros(len(points), bool)
    again[1:] = space[1:] & space[:-1]
    again[bounds[:-1][bounds[:-1] < len(points)]] = False
    at = np.flatnonzero(~again)
    out = points[at]
    flat = out < len(_LOWER)
    out = np.where(flat, _LOWER[np.minimum(out, len(_LOWER) - 1)], out)
    out[space[at]] = 32
    return out, at, np.searchsorted(at, bounds)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams; code points are folded to a byte, which can only add shared grams."""
    return ta.gram_hash(ta.prefix_hash(((points ^ (points >> np.uint32(8))) & np.uint32(0xFF)).astype(np.uint8)), q)


class Items:
    """Items that are searched with one q, and where each of its q-grams occurs in them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], segment: int, rate: float, q: int) -> None:
        self.q = q
        self.item = np.array([item for item, _ in items], np.int64)
        self.length = np.array([len(text) for _, text in items], np.int64)
        self.size = np.minimum(self.length, segment)
        self.budget = np.floor(self.size * rate).astype(np.int64)
        self.need = np.maximum(1, self.size + 1 - (self.budget + 1) * q)
        self.start = np.cumsum(self.length) - self.length
        self.text = np.concatenate([text for _, text in items]).astype(np.uint32)
        grams = [_grams(text, q) for _, text in items]
        counts = [len(g) for g in grams]
        all_grams = np.concatenate(grams)
        order = np.argsort(all_grams, kind="stable")
        self.grams, first, count = np.unique(all_grams[order], return_index=True, return_counts=True)
        row, place = np.repeat(np.arange(len(items)), counts)[order], np.concatenate([np.arange(n) for n in counts])[order]
        self.first, self.count, self.row, self.place = (x.astype(np.int32) for x in (first, count, row, place))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - _TABLE_BITS)] = True


class Benchmark:
    """A block of items: those that `q` serves, and those too short for it."""

    def __init__(self, items: list[tuple[int, str]], segment: int, rate: float, q: int) -> None:
        by_q: dict[bool, list[tuple[int, np.ndarray]]] = {}
        least = q
        for item, text in items:
            raw = np.frombuffer(text.strip().encode("utf-32-le", "replace"), "<u4")
            clean = normalised(raw, np.array([0, len(raw)]))[0]
            if len(clean) < q:
                continue
            size = min(len(clean), segment)
            own = max(1, min(q, size // (int(size * rate) + 1)))
            by_q.setdefault(own == q, []).append((item, clean))
            least = min(least, own)
        self.parts = [Items(part, segment, rate, q if full else least) for full, part in by_q.items()]


def align(segments: np.ndarray, sizes: np.ndarray, regions: np.ndarray, budget: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits between each segment and any part of its region, with start and end of that part.

    Rows of `regions` begin where the first diagonal of the band does; column d of the band is diagonal d. Cost and
    start travel in one number, so the smallest is the cheapest and, among those, the first to start. Cases that cannot
    stay within `budget` are given up; their edits are only known to be more.
    """
    cases, width = len(segments), regions.shape[1] - segments.shape[1] + 1
    step = np.arange(width, dtype=np.int64)
    row = np.tile(step, (cases, 1))
    best = np.zeros((cases, 3), np.int64)
    best[:, 0] = segments.shape[1] + 1
    live = np.arange(cases)
    for i in range(segments.shape[1]):
        if budget is not None and i % 8 == 0:
            on = (row.min(axis=1) < (budget[live] + 1) * _COST) & (sizes > i)
            if not on.all():
                row, live, segments, sizes, regions = row[on], live[on], segments[on], sizes[on], regions[on]
            if not len(live):
                break
        change = row + _COST * (regions[:, i : i + width] != segments[:, i : i + 1])
        skip = np.full_like(row, np.iinfo(np.int64).max // 2)
        skip[:, :-1] = row[:, 1:] + _COST
        row = np.minimum(change, skip)
        row = np.minimum.accumulate(row - step * _COST, axis=1) + step * _COST
        done = np.flatnonzero(sizes == i + 1)
        if len(done):
            at = row[done].argmin(axis=1)
            value = row[done, at]
            best[live[done]] = np.stack((value // _COST, value % _COST, at + i + 1), axis=1)
    return best[:, 0], best[:, 1], best[:, 2]


def _hits(text: np.ndarray, bounds: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, row of the item, place in the document, place in the item) of q-grams that stand close enough together."""
    grams = _grams(text, items.q)
    maybe = np.flatnonzero(items.table[grams >> np.uint64(64 - _TABLE_BITS)])
    found = np.searchsorted(items.grams, grams[maybe])
    found[found == len(items.grams)] = 0
    exact = items.grams[found] == grams[maybe]
    place, found = maybe[exact], found[exact]
    doc = np.searchsorted(bounds, place, "right") - 1
    whole = place + items.q <= bounds[doc + 1]
    place, found = place[whole], found[whole]
    # Places with too few hits around them for any segment need no postings.
    reach, least = int((items.size + items.budget).max()), int(items.need.min())
    ahead = np.searchsorted(place, place + reach, "right")
    dense = np.flatnonzero(ahead - np.arange(len(place)) >= least)
    edge = np.zeros(len(place) + 1, np.int64)
    np.add.at(edge, dense, 1)
    np.add.at(edge, ahead[dense], -1)
    inside = np.cumsum(edge[:-1]) > 0
    place, found = place[inside], found[inside]
    counts = items.count[found]
    hit = np.repeat(np.arange(len(place)), counts)
    entry = np.repeat(items.first[found], counts) + np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = place[hit]
    doc = np.searchsorted(bounds, place, "right") - 1
    return doc, items.row[entry], place - bounds[doc], items.place[entry]


def _segments(text: np.ndarray, bounds: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, row of the item, place in the item, start, end, edits) of found segments; start and end are in the document."""
    doc, row, place, own = _hits(text, bounds, items)
    if not len(doc):
        return
    # Shared q-grams of a segment lie on `half` diagonals in a row at most: in two neighbouring halves of bands.
    half, offset, longest = int(items.budget.max()) + 1, int(items.length.max()), int(items.size.max())
    diagonal = place - own + offset
    bands = int(diagonal.max()) // half + 2
    key = (doc * len(items.item) + row) * bands + diagonal // half
    order = np.argsort(key, kind="stable")
    key, diagonal, own = key[order], diagonal[order], own[order]
    keys, first = np.unique(key, return_index=True)
    last = np.append(first[1:], len(key))
    # A band whose lower half is empty is covered by the next one.
    paired = np.append(keys[1:] == keys[:-1] + 1, False)
    end = np.where(paired, np.append(last[1:], len(key)), last)
    pair, band = keys // bands, keys % bands
    docs, rows = pair // len(items.item), pair % len(items.item)
    todo: list[np.ndarray] = []
    waiting = 0
    for n in np.flatnonzero(end - first >= items.need[rows]):
        d, r = int(docs[n]), int(rows[n])
        size, length = int(items.size[r]), int(items.length[r])
        starts = np.arange(length - size + 1)
        hits = np.sort(own[first[n] : end[n]])
        shared = np.searchsorted(hits, starts + size - items.q, "right") - np.searchsorted(hits, starts, "left")
        starts = starts[shared >= items.need[r]]
        if not len(starts):
            continue
        # Segments that stand there unchanged, on the diagonal with the most hits.
        straight = int(np.bincount(diagonal[first[n] : end[n]] - band[n] * half).argmax()) + int(band[n]) * half - offset
        at = bounds[d] + straight + np.arange(length)
        good = (at >= bounds[d]) & (at < bounds[d + 1])
        wrong = np.concatenate(([0], np.cumsum(~good | (text[np.clip(at, 0, len(text) - 1)] != items.text[items.start[r] : items.start[r] + length]))))
        same = wrong[starts + size] == wrong[starts]
        if same.any():
            s = starts[same]
            yield np.full(len(s), d), np.full(len(s), r), s, s + straight, s + straight + size, np.zeros(len(s), np.int64)
        s = starts[~same]
        todo.append(np.stack((np.full(len(s), d), np.full(len(s), r), s, s + (band[n] - 1) * half - offset)))
        waiting += len(s)
        if waiting >= 2000:
            yield from _aligned(text, bounds, items, np.concatenate(todo, axis=1), half, longest)
            todo, waiting = [], 0
    if waiting:
        yield from _aligned(text, bounds, items, np.concatenate(todo, axis=1), half, longest)


def _aligned(text: np.ndarray, bounds: np.ndarray, items: Items, cases: np.ndarray, half: int, longest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Those of the cases (document, row, place in the item, first diagonal's place) that are within their budget."""
    for a in range(0, cases.shape[1], 2000):
        d, r, s, left = cases[:, a : a + 2000]
        columns = (bounds[d] + left)[:, None] + np.arange(longest + 4 * half)
        own = (columns >= bounds[d][:, None]) & (columns < bounds[d + 1][:, None])
        region = np.where(own, text[np.clip(columns, 0, len(text) - 1)], _OUTSIDE)
        segment = items.text[items.start[r][:, None] + np.minimum(s[:, None] + np.arange(longest), items.length[r][:, None] - 1)]
        edits, start, end = align(segment, items.size[r], region, items.budget[r])
        n = np.flatnonzero(edits <= items.budget[r])
        if len(n):
            yield d[n], r[n], s[n], left[n] + start[n], left[n] + end[n], edits[n]


def find_matches(data: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, start, end, edits, segments) of every item that a document holds a segment of."""
    if not bench.parts or not len(data):
        return []
    raw, raw_bounds = _characters(data, offsets)
    text, at, bounds = normalised(raw, raw_bounds)
    out: dict[tuple[int, int], list] = {}
    for number, items in enumerate(bench.parts):
        for found in _segments(text, bounds, items):
            for d, r, s, start, end, edits in zip(*(x.tolist() for x in found), strict=True):
                low, high = int(bounds[d]), int(bounds[d + 1]) - 1
                first = int(at[min(max(low + start, low), high)] - raw_bounds[d])
                stop = int(at[min(max(low + end - 1, low), high)] + 1 - raw_bounds[d])
                new = [first, stop, edits, {(number, r, s)}]
                have = out.setdefault((d, int(items.item[r])), new)
                if have is not new:
                    have[0], have[1], have[2] = min(have[0], first), max(have[1], stop), min(have[2], edits)
                    have[3] |= new[3]
    return [(d, item, *v[:3], len(v[3])) for (d, item), v in sorted(out.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_chars` characters; one block is in the driver at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        yield [(r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]


def _broadcast(docs: DataFrame, items: list[tuple[int | None, str]], segment: int, rate: float, q: int):  # noqa: ANN202
    return docs.sparkSession.sparkContext.broadcast(Benchmark([(-1 if i is None else i, t) for i, t in items], segment, rate, q))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment: int = 100, rate: float = 0.08, q: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and benchmark item it holds: id, item, start, end (code points), edits, n_segments.

    An item counts if a segment of it (any `segment` characters in a row, or the whole item if shorter) is found within
    `rate` edits per character; edits are those of its best segment, start and end span all of them. Items of fewer than `q`
    characters are never found; null texts hold nothing; repeated rows give repeated results; null items keep their null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def scan(bench) -> Callable[[Batches], Batches]:  # noqa: ANN001
        def run(batches: Batches) -> Batches:
            for batch in batches:
                for a, _, data, offsets in ta.chunks(batch.column("text")):
                    rows = find_matches(data, offsets, bench.value)
                    if rows:
                        d, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array([a + x for x in d])), *[pa.array(c, pa.int64()) for c in rest]], names=["doc", "item", "start", "end", "edits", "n_segments"])

        return run

    out = None
    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        part = slim.mapInArrow(scan(_broadcast(docs, items, segment, rate, q)), f"doc {kind}, item long, start long, end long, edits long, n_segments long")
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits", "n_segments")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment: int = 100, rate: float = 0.08, q: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; see `contaminated`."""
    place = docs.columns.index(text_col)

    def keep(bench) -> Callable[[Batches], Batches]:  # noqa: ANN001
        def run(batches: Batches) -> Batches:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in ta.chunks(batch.column(place)):
                    good[[a + row[0] for row in find_matches(data, offsets, bench.value)]] = False
                yield batch.filter(pa.array(good))

        return run

    for items in _blocks(benchmark, item_col, item_text_col, block_chars):
        docs = docs.mapInArrow(keep(_broadcast(docs, items, segment, rate, q)), docs.schema)
    return docs
