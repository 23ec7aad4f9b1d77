"""Repeated substrings, found with longest-previous-factor arrays.

Only strings of at least `length` bytes matter, so suffixes are compared to that depth. Every window of `length` bytes
holds grams of `gram` bytes, and the smallest gram hash in it names the bucket of the window: equal windows always meet
in one bucket, wherever they start. Windows that follow each other and share their bucket form a segment, a few bytes
of bookkeeping for about a hundred windows, and only segments whose bucket occurs again go on.

1. Segments with equal bytes are counted before anything is shuffled together; a passage that thousands of documents
   share is one class with a count.
2. One segment of each class sends its bytes to its bucket. There the suffixes are sorted (prefix doubling), and for
   each window the previous smaller position in suffix order tells whether an earlier window is equal, the next larger
   one whether a later window is.
3. A bucket with more than `bucket_limit` classes is not gathered: its windows are counted by a 128-bit hash, which
   is exact in the same sense and needs no group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlelake.llm import textarrays as ta
from candlelake.llm.shared import keep as keep_table

#: Bytes of segments that are sorted together in one step of a task.
SORT_BYTES = 1_000_000
SEGMENT = "bucket long, content long, id long, mark long, start int, windows int, own boolean"
CONTEXT = "bucket long, id long, mark long, start int, windows int, shared boolean, large boolean, bytes binary"
SPAN = "id long, mark long, start int, stop int"
_SEGMENT = pa.schema([("bucket", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("own", pa.bool_())])
_CONTEXT = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("shared", pa.bool_()), ("large", pa.bool_()), ("bytes", pa.binary())])
_SPAN = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
Batches = Iterator[pa.RecordBatch]


# --- segments --------------------------------------------------------------------------------------


def smallest_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, from block-wise running minima in both directions."""
    n = len(values)
    if n < width:
        return np.empty(0, values.dtype)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, bucket and self-repetition of every segment."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    grams = ta.gram_hash(ta.prefix_hash(data), gram)
    bits = np.uint64(max(24, len(data).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    ranked = grams & ~low
    ranked |= np.arange(len(grams), dtype=np.uint64)
    best = smallest_in_window(ranked, length - gram + 1)
    edges = np.zeros(len(best) + 1, np.int32)
    np.add.at(edges, offsets[long], 1)
    stops = offsets[long] + sizes[long] - length + 1
    np.add.at(edges, stops[stops < len(edges)], -1)
    window = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    where = (best[window] & low).astype(np.int64)
    bucket = grams[where]
    doc = np.searchsorted(offsets, window, "right") - 1
    same_doc = np.zeros(len(window), bool)
    same_doc[1:] = (window[1:] == window[:-1] + 1) & (doc[1:] == doc[:-1])
    fresh = ~same_doc
    fresh[1:] |= bucket[1:] != bucket[:-1]
    first = np.flatnonzero(fresh)
    moved = np.zeros(len(window), np.int64)
    moved[1:] = where[1:] != where[:-1]
    moved[first] = 0
    counts = np.diff(np.append(first, len(window)))
    return doc[first], window[first], counts, bucket[first], np.add.reduceat(moved, first) > 0


def _segments(length: int, gram: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for row, _, data, offsets in ta.chunks(batch.column("text")):
                doc, start, count, bucket, own = segments_of(data, offsets, length, gram)
                if not len(doc):
                    continue
                view = memoryview(np.ascontiguousarray(data))
                digest = xxhash.xxh3_64_intdigest
                stop = start + count - 1 + length
                content = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[row + doc]), pa.array(marks[row + doc]),
                     pa.array((start - offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(own)], schema=_SEGMENT)

    return run


def _contexts(length: int) -> Callable[[Batches], Batches]:
    """The bytes of the listed segments of each document."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for id_, mark, text, wanted in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist(), strict=True):
                body = memoryview(text.as_buffer())
                for w in wanted:
                    piece = bytes(body[w["start"] : w["start"] + w["windows"] - 1 + length])
                    rows.append((w["bucket"], id_, mark, w["start"], w["windows"], w["shared"], w["large"], piece))
                    size += len(piece)
                if size > 4 * ta.CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CONTEXT.types, strict=True)], schema=_CONTEXT)

    return run


# --- suffix order and longest previous factors ------------------------------------------------------


def suffix_ranks(data: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Rank, in suffix order to a depth of `length`, of the suffixes that start at `at`; equal ranks share `length` bytes.

    Prefix doubling: ranks to depth h give ranks to 2h; the last step overlaps two of the largest power.
    """
    if length < 8:
        raise ValueError("length must be 8 or more")
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    key = np.zeros(len(data), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(data)].astype(np.uint64)
    depth = 8
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while depth * 2 <= length:
        key = rank << np.uint64(32)
        key[: len(data) - depth] |= rank[depth:] + np.uint64(1)
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
    if depth == length:
        return rank[at].astype(np.int64)
    return np.unique((rank[at] << np.uint64(32)) | rank[at + (length - depth)], return_inverse=True)[1]


def factor_matches(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an earlier, and whether a later, suffix matches to full depth.

    Suffixes of equal rank are ordered by position, so in this order the previous smaller position of a suffix is the
    entry before it and the next larger one the entry after it; any other smaller position shares less. The longest
    previous factor therefore reaches full depth exactly if the entry before has the same rank.
    """
    order = np.lexsort((position, rank))
    ranked = rank[order]
    equal = ranked[1:] == ranked[:-1]
    before, after = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    before[order[1:]] = equal
    after[order[:-1]] = equal
    return before, after


def _sorted_group(group: pa.Table, length: int, keep: str) -> pa.RecordBatch:
    """Spans of repeated windows among the segments of some whole buckets."""
    data, offsets = ta.flat(group.column("bytes").combine_chunks())
    windows = group.column("windows").to_numpy().astype(np.int64)
    ids, marks, starts = (group.column(c).to_numpy() for c in ("id", "mark", "start"))
    segment = np.repeat(np.arange(len(windows)), windows)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = suffix_ranks(data, length, offsets[segment] + step)
    by_document = np.empty(len(windows), np.int64)
    by_document[np.lexsort((starts, marks, ids))] = np.arange(len(windows))
    before, after = factor_matches(rank, by_document[segment] * (int(windows.max()) + 1) + step)
    if keep == "none":
        gone = (before | after) & ~group.column("shared").to_numpy(zero_copy_only=False)[segment]
    else:
        gone = before
    at = np.flatnonzero(gone)
    if not len(at):
        return pa.RecordBatch.from_pylist([], schema=_SPAN)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]])
    last = np.ones(len(at), bool)
    last[:-1] = fresh[1:]
    a, b = at[fresh], at[last]
    s = segment[a]
    return pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(marks[s]), pa.array((starts[s] + step[a]).astype(np.int32)), pa.array((starts[s] + step[b] + length).astype(np.int32))], schema=_SPAN)


def _bucket_spans(length: int, keep: str) -> Callable[[Batches], Batches]:
    """Reads segments ordered by bucket and sorts about SORT_BYTES of whole buckets at a time."""

    def run(batches: Batches) -> Batches:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            _, offsets = ta.flat(batch.column("bytes"))
            bucket = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            done = 0
            if waiting and len(bucket) and waiting[-1].column("bucket")[-1].as_py() != bucket[0] and size >= SORT_BYTES:
                yield _sorted_group(pa.Table.from_batches(waiting), length, keep)
                waiting, size = [], 0
            for cut in cuts.tolist():
                if size + int(offsets[cut] - offsets[done]) >= SORT_BYTES:
                    waiting.append(batch.slice(done, cut - done))
                    yield _sorted_group(pa.Table.from_batches(waiting), length, keep)
                    waiting, size, done = [], 0, cut
            if done < len(bucket):
                waiting.append(batch.slice(done))
                size += int(offsets[-1] - offsets[done])
        if waiting:
            yield _sorted_group(pa.Table.from_batches(waiting), length, keep)

    return run


def _window_hashes(length: int) -> Callable[[Batches], Batches]:
    """128 bits of every window of a segment, for buckets too large for one task."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                view = memoryview(data)
                n = row["windows"]
                other = np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + length], 1) for i in range(n)), np.uint64, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ta.gram_hash(ta.prefix_hash(data), length)[:n].view(np.int64)), pa.array(other.view(np.int64)), pa.array(np.full(n, row["id"])),
                     pa.array(np.full(n, row["mark"])), pa.array((row["start"] + np.arange(n)).astype(np.int32)), pa.array(np.full(n, row["shared"]))],
                    names=["h1", "h2", "id", "mark", "start", "shared"])

    return run


# --- the operator ----------------------------------------------------------------------------------


def _merged(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column("text").cast(pa.binary()), batch.column("found").to_pylist(), strict=True):
                body = text.as_buffer().to_pybytes()
                out: list[list[int]] = []
                for a, b in sorted((x["start"], x["stop"]) for x in found or ()):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                bounds = [0, *(x for pair in out for x in pair), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in out])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("size"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["doc", "size", "kept", "spans"])

    return run


def _struct(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "first", gram: int = 128, bucket_limit: int = 4096) -> DataFrame:
    """Cut every byte that a repeated string of `length` bytes covers.

    Texts are taken as UTF-8 bytes; null counts as empty; matches stay inside one document. With `keep="first"` the
    first occurrence (by id, then by place) stays and only later copies go; with `keep="none"` all occurrences go.
    Strings are judged on the input, never on what is left. Returns one row per input row: `id_col`, n_bytes, kept
    (binary, what is left), spans (removed runs as [start, stop) of bytes, in order). Runs that touch are one.

    Empty tables give no rows and texts under `length` bytes stay whole. Ids must be integers; null and repeated ids
    are allowed. Rows that agree in id and text are copies of each other; with `keep="first"` they count as one document.
    Other columns are not read. Eager: some intermediate tables are written to the shared folder when called.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep must be 'first' or 'none'")
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and shorter than length")
    base = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("doc", "text"))
    found = keep_table(base.select("id", "mark", "text").filter(F.octet_length("text") >= length).mapInArrow(_segments(length, gram), SEGMENT))

    again = found.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("self")).filter("n > 1 OR self").select("bucket")
    kept = keep_table(found.join(again, "bucket"))
    classes = keep_table(
        kept.groupBy("bucket", "content")
        .agg(F.count("*").alias("n"), F.min(_struct("id", "mark", "start", "windows")).alias("first"), F.max("own").alias("own"))
    )
    # A class needs comparing if its bucket has others and one of them is not settled by its own count, or it repeats in itself.
    settled = F.col("n") > 1 if keep == "none" else F.lit(False)
    state = classes.groupBy("bucket").agg(F.count("*").alias("members"), F.max(~settled).alias("unsettled"), F.max("own").alias("self"))
    edges = (
        classes.join(state.filter("(members > 1 AND unsettled) OR self"), "bucket")
        .select("bucket", "first.*", settled.alias("shared"), (F.col("members") > bucket_limit).alias("large"))
    )
    copies = kept.join(classes.filter("n > 1").select("bucket", "content", "first"), ["bucket", "content"])
    if keep == "first":
        copies = copies.filter((F.col("id") != F.col("first.id")) | (F.col("mark") != F.col("first.mark")) | (F.col("start") != F.col("first.start")))
    spans = copies.select("id", "mark", "start", (F.col("start") + F.col("windows") - 1 + length).alias("stop"))

    wanted = edges.groupBy("id", "mark").agg(F.collect_set(_struct("bucket", "start", "windows", "shared", "large")).alias("wanted"))
    contexts = keep_table(base.join(wanted, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("id", "mark", "text", "wanted").mapInArrow(_contexts(length), CONTEXT))
    compared = contexts.filter("NOT large").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_spans(length, keep), SPAN)
    hashed = contexts.filter("large").mapInArrow(_window_hashes(length), "h1 long, h2 long, id long, mark long, start int, shared boolean")
    repeated = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_struct("id", "mark", "start")).alias("first")).filter("n > 1")
    stay = F.col("shared") if keep == "none" else _struct("id", "mark", "start") == F.col("first")
    counted = hashed.join(repeated, ["h1", "h2"]).filter(~stay).select("id", "mark", "start", (F.col("start") + length).alias("stop"))

    lists = spans.unionByName(compared).unionByName(counted).groupBy("id", "mark").agg(F.collect_set(_struct("start", "stop")).alias("found"))
    return (
        base.join(lists, ["id", "mark"], "left")
        .select("doc", F.octet_length("text").cast("long").alias("size"), "text", "found")
        .mapInArrow(_merged(length), "doc long, size long, kept binary, spans array<struct<start:int,stop:int>>")
        .select(F.col("doc").alias(id_col), F.col("size").alias("n_bytes"), "kept", "spans")
    )
