"""Repeated lines dropped across documents, found by two Bloom filters.

Every task marks its lines in a filter of lines seen once; a line that is marked there already goes into a filter of
lines seen twice. The filters of all tasks merge bit by bit: what two of them have seen once has been seen twice. No
repeated line escapes the merged second filter, and few others pass it. Only lines that pass it shuffle, as the SHA-256
of their key, to be counted exactly; only documents with such a line shuffle to lose it.

A filter has 5 bits or more for each `min_chars` bytes of text, a power of two of them: 5 for each line if all lines were
as short as lines that count can be, and far more as lines are. So its share of set bits does not grow with the input, up
to `max_filter_bytes`, the bound on what is broadcast; a task holds two filters. Beyond that bound more lines shuffle;
which lines are dropped never depends on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.llm.shared import keep

Batches = Iterator[pa.RecordBatch]

#: Filter words (of 64 bits) that travel as one row, at most.
SEGMENT = 8192
_SPACE = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)
_CODEC = "zstd"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case (other letters stay)."""
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _parts(batches: Batches) -> Batches:
    """A few hundred rows at a time, so that little besides the batch itself is held."""
    for batch in batches:
        yield from (batch.slice(at, 256) for at in range(0, batch.num_rows, 256))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(line) for line in text.split(b"\n")}
    return {k for k in keys if _long_enough(k, min_chars)}


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of each hash, and its four bits there."""
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return ((hashes >> np.uint64(24)) % np.uint64(words)).astype(np.int64), mask


def mark(hashes: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """Enter line hashes, one for each document that holds the line, into both filters."""
    value, seen = np.unique(hashes, return_counts=True)
    word, mask = _places(value, len(once))
    again = (seen > 1) | ((once[word] & mask) == mask)
    np.bitwise_or.at(twice, word[again], mask[again])
    np.bitwise_or.at(once, word, mask)


def merge(once: np.ndarray, twice: np.ndarray, other_once: np.ndarray, other_twice: np.ndarray) -> None:
    """Add the filters of another task to the first two."""
    twice |= other_twice | (once & other_once)
    once |= other_once


def _pack(words: np.ndarray) -> bytes:
    return pa.compress(words.tobytes(), _CODEC, asbytes=True) if words.any() else b""


def _unpack(body: bytes, words: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, words * 8, _CODEC, asbytes=True), np.uint64) if body else np.zeros(words, np.uint64)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _task_filters(words: int, min_chars: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in _parts(batches):
            hashes = [xxhash.xxh3_64_intdigest(k) for t in _texts(batch) for k in _keys(t, min_chars)]
            mark(np.array(hashes, np.uint64), once, twice)
        for n in range(0, words, SEGMENT):
            part = slice(n, n + SEGMENT)
            if once[part].any():
                yield _rows([(n, _pack(once[part]), _pack(twice[part]))], ["segment", "once", "twice"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def _merged(words: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = min(words, SEGMENT)
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = found.setdefault(row["segment"], (np.zeros(size, np.uint64), np.zeros(size, np.uint64)))
                merge(once, twice, _unpack(row["once"], size), _unpack(row["twice"], size))
        for n, (_, twice) in found.items():
            if twice.any():
                yield _rows([(n, _pack(twice))], ["segment", "twice"], [pa.int32(), pa.binary()])

    return run


class SeenTwice:
    """The merged filter of lines that at least two documents hold, as it lies in a broadcast variable."""

    _ready: tuple[object, np.ndarray] | None = None

    def __init__(self, words: int, segments: dict[int, bytes]) -> None:
        self.words, self.segments = words, segments

    def filled(self) -> np.ndarray:
        if SeenTwice._ready is None or SeenTwice._ready[0] is not self:
            out = np.zeros(self.words, np.uint64)
            for n, body in self.segments.items():
                out[n : n + SEGMENT] = _unpack(body, min(self.words, SEGMENT))
            SeenTwice._ready = (self, out)
        return SeenTwice._ready[1]

    def suspects(self, keys: list[bytes]) -> list[bytes]:
        if not keys:
            return []
        filled = self.filled()
        word, mask = _places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), self.words)
        return [keys[i] for i in np.flatnonzero((filled[word] & mask) == mask)]


def _filter_words(docs: DataFrame, min_chars: int, max_filter_bytes: int) -> int:
    """Words of a filter: a line that counts has `min_chars` bytes at least, so the bytes bound their number."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = 1
    while words * 64 < 5 * size // min_chars and words * 16 <= max_filter_bytes:
        words *= 2
    return words


def seen_twice(docs: DataFrame, min_chars: int, max_filter_bytes: int) -> SeenTwice:
    words = _filter_words(docs, min_chars, max_filter_bytes)
    parts = docs.select("text").mapInArrow(_task_filters(words, min_chars), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(_merged(words), "segment int, twice binary")
    return SeenTwice(words, {r["segment"]: bytes(r["twice"]) for r in merged.collect()})


def _suspect_rows(seen, min_chars: int) -> Callable[[Batches], Batches]:  # noqa: ANN001
    def run(batches: Batches) -> Batches:
        for batch in _parts(batches):
            rows = []
            for id_, text in zip(batch.column("id").to_pylist(), _texts(batch), strict=True):
                rows += [(id_, hashlib.sha256(k).digest()) for k in seen.value.suspects(list(_keys(text, min_chars)))]
            yield _rows(rows, ["id", "key"], [pa.int64(), pa.binary()])

    return run


def _with_suspects(seen, min_chars: int, wanted: bool) -> Callable[[Batches], Batches]:  # noqa: ANN001
    """The rows of documents that hold a suspected line, or of those that hold none."""

    def run(batches: Batches) -> Batches:
        for batch in _parts(batches):
            yield batch.filter(pa.array([bool(seen.value.suspects(list(_keys(t, min_chars)))) == wanted for t in _texts(batch)], pa.bool_()))

    return run


def _without(batches: Batches) -> Batches:
    for batch in _parts(batches):
        rows = []
        for id_, text, gone in zip(batch.column("id").to_pylist(), _texts(batch), batch.column("gone").to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = set(gone or ())
            left = [line for line in lines if hashlib.sha256(line_key(line)).digest() not in gone] if gone else lines
            rows.append((id_, len(lines), len(lines) - len(left), b"\n".join(left).decode()))
        yield _rows(rows, ["id", "n_lines", "n_dropped", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, max_filter_bytes: int = 1 << 25) -> DataFrame:
    """One row per row: `id_col`, n_lines, n_dropped, kept (the lines that stay, joined by \\n).

    Texts are split at \\n; null and empty texts are one empty line. A line goes if its key (see `line_key`) has
    `min_chars` code points and stands in `min_docs` documents (two at least), unless this is the document of the
    largest id among them; all lines of a document with that key go or stay together. Rows that share an id are one
    document, a null id is an id of its own and the smallest. Ids are integers. Other columns are not read, an empty
    table gives an empty one. Eager: the filter is built, and the suspected lines are written, when called.
    """
    if min_docs < 2 or min_chars < 1:
        raise ValueError("min_docs must be 2 or more, min_chars 1 or more")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    seen = docs.sparkSession.sparkContext.broadcast(seen_twice(base, min_chars, max_filter_bytes))
    found = keep(base.mapInArrow(_suspect_rows(seen, min_chars), "id long, key binary"))
    # A table of its own, so that the join below can split the rows of a line that very many documents hold.
    repeated = keep(found.groupBy("key").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("last")).filter(F.col("docs") >= min_docs))
    gone = found.join(repeated, "key").filter("id <> last").groupBy("id").agg(F.collect_set("key").alias("gone"))
    touched = base.mapInArrow(_with_suspects(seen, min_chars, True), base.schema).join(gone, "id", "left").select("id", "text", "gone")
    clean = base.mapInArrow(_with_suspects(seen, min_chars, False), base.schema).withColumn("gone", F.lit(None).cast("array<binary>"))
    out = touched.unionAll(clean).mapInArrow(_without, "id long, n_lines long, n_dropped long, kept string")
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_lines", "n_dropped", "kept")
