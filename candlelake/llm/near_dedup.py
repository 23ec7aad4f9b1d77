"""Near-duplicate texts by DartMinHash over five-word shingles.

A text is a weighted set: its shingles with the number of times each occurs. Every shingle owns a plane of weight by
rank on which darts fall, one per unit of area on average, at places that depend on the shingle alone. A text sees the
darts under its weights up to a rank limit chosen so that a few hundred are seen, however many shingles it has. Each
dart belongs to one of `k` coordinates, and the seen dart of lowest rank is the value of its coordinate: two texts agree
there with the probability of their weighted Jaccard similarity. Where a coordinate saw no dart, the limit is doubled.

Bands of coordinates give candidate pairs, exact similarity decides. Groups are never expanded into all pairs: members
of a bucket are compared with one hub each. Buckets that then still hold different components are compared in full, small
ones by pairs, large ones in blocks inside tasks of bounded size, which return no more links than join the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.llm import textarrays as ta
from candlelake.llm.components import components
from candlelake.llm.shared import keep

Batches = Iterator[pa.RecordBatch]

#: Distribution function of the number of darts in a cell of area 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 21.0)))))
#: Buckets of up to PAIRED members are expanded into pairs; larger ones meet in blocks of about BLOCK members.
PAIRED, BLOCK = 16, 512
#: Bytes of text that are hashed at once; working arrays take some 20 times as much.
CHUNK = 400_000
_LOW48 = np.uint64((1 << 48) - 1)
_NO_ID = -(1 << 63)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 48-bit hash and count of every distinct shingle. A text of fewer words than `size` is one shingle."""
    begins, ends, doc = ta.words(data, offsets)
    if not len(begins):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ta.span_hash(ta.prefix_hash(data), begins, ends)
    value, first = ta.shingles(word, doc, size)
    per_doc = np.bincount(doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((per_doc > 0) & (per_doc < size))
    owner = doc[first]
    if len(short):
        at = np.searchsorted(doc, short)
        whole = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = per_doc[short] > j
            whole[has] = ta.mix(whole[has] * np.uint64(31) + word[at[has] + j])
        value, owner = np.concatenate((value, whole)), np.concatenate((owner, short))
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (value & _LOW48))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    return (key[at] >> np.uint64(48)).astype(np.int64), key[at] & _LOW48, np.diff(np.append(at, len(key)))


def dart_signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """A (docs, k) array of dart names; rows of documents without items are 0."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=docs)
    target = k * (np.log(k) + 2.0)
    open_docs = np.flatnonzero(total > 0)
    while len(open_docs):
        limit = np.zeros(docs)
        limit[open_docs] = target / total[open_docs]
        chosen = np.flatnonzero(limit[doc] > 0)
        kept: list[tuple[np.ndarray, ...]] = []
        low, width, level = 0.0, 1.0, 0
        while len(chosen):
            rows = np.ceil(limit[doc[chosen]] * width).astype(np.int64)
            owner = np.repeat(chosen, rows)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
            seed = ta.mix(item[owner] * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(level * 0x165667B19E3779F9 % 2**64))
            darts = np.searchsorted(_POISSON, _unit(seed), "right")
            owner, step = np.repeat(owner, darts), np.repeat(step, darts)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
            name = ta.mix(np.repeat(seed, darts) + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            rank = (step + _unit(name)) / width
            seen = np.flatnonzero(rank < limit[doc[owner]])
            owner, name, rank = owner[seen], name[seen], rank[seen]
            name = ta.mix(name)
            if level or weight[chosen].min() < 1:
                under = low + width * _unit(ta.mix(name + np.uint64(7))) < weight[owner]
                owner, name, rank = owner[under], name[under], rank[under]
            kept.append((doc[owner], name, rank))
            low, width, level = low + width, width if level == 0 else width * 2, level + 1
            chosen = chosen[weight[chosen] > low]
        owner, name, rank = (np.concatenate(c) for c in zip(*kept, strict=True))
        slot = owner * k + (ta.mix(name ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64)
        order = np.argsort((slot.astype(np.uint64) << np.uint64(40)) | (rank / limit[owner] * 2.0**40).astype(np.uint64))
        slot, name = slot[order], name[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        flat = out.reshape(-1)
        flat[slot[first]] = name[first]
        filled = np.bincount(slot[first] // k, minlength=docs)
        open_docs = open_docs[filled[open_docs] < k]
        target *= 2
    return out


def _signatures(size: int, bands: int, rows: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, offsets in ta.chunks(batch.column("text"), CHUNK):
                doc, item, weight = shingle_sets(data, offsets, size)
                values = dart_signatures(doc, item, weight.astype(np.float64), b - a, bands * rows).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), np.uint64)
                for r in range(rows):
                    key = ta.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
                key += np.arange(bands, dtype=np.uint64)
                total = np.bincount(doc, weights=weight, minlength=b - a).astype(np.int64)
                some = total > 0
                bounds = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[some].reshape(-1).view(np.int64)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h1"), part.column("h2"), pa.array(total), lists], names=["id", "h1", "h2", "weight", "bands"])

    return run


def _shingle_lists(size: int) -> Callable[[Batches], Batches]:
    """Shingles of each text as sorted 32-bit values, the n-th occurrence of one under a value of its own."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, data, offsets in ta.chunks(batch.column("text"), CHUNK):
                doc, item, weight = shingle_sets(data, offsets, size)
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                owner = np.repeat(doc, weight)
                value = ta.mix(np.repeat(item, weight) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                value = np.sort((owner.astype(np.uint64) << np.uint64(32)) | value)
                ends = np.searchsorted(value, np.arange(1, b - a + 1, dtype=np.uint64) << np.uint64(32)) * 4
                body = value.astype(np.uint32).tobytes()
                lists = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes()), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), lists], names=["node", "items"])

    return run


def _similar(threshold: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = common >= threshold * (len(both) - common) and common > 0
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    return run


def _block_links(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links between components, found among the members of one block or between those of two.

    Common shingles are counted by a matrix product, a few thousand shingles at a time. Of the links found only as many
    are returned as join the components that the group holds.
    """

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block").to_numpy()
        low = int(group.column("i")[0].as_py())
        first = np.flatnonzero(block == low)
        second = first if low == group.column("j")[0].as_py() else np.flatnonzero(block != low)
        nodes, labels = group.column("node").to_numpy(), group.column("label").to_numpy()
        data, offsets = ta.flat(group.column("items").combine_chunks())
        size = np.diff(offsets) // 4
        value, column, seen = np.unique(data.view(np.uint32), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(size)), size)
        shared = np.flatnonzero(seen > 1)
        rank = np.full(len(value), -1)
        rank[shared] = np.arange(len(shared))
        column = rank[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(first), len(second)), np.float32)
        for a in range(0, len(shared), 4096):
            part = slice(np.searchsorted(column, a), np.searchsorted(column, a + 4096))
            there = np.zeros((len(size), min(4096, len(shared) - a)), np.float32)
            there[owner[part], column[part] - a] = 1
            common += there[first] @ there[second].T
        good = common >= threshold * (size[first][:, None] + size[second][None, :] - common)
        x, y = np.nonzero(good & (labels[first][:, None] != labels[second][None, :]) & (common > 0))
        x, y = first[x], second[y]
        parent = {int(n): int(n) for n in np.unique(labels)}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        names, at = np.unique(labels, return_inverse=True)
        _, once = np.unique(at[x] * len(names) + at[y], return_index=True)
        kept = []
        for n in once.tolist():
            a, b = root(int(labels[x[n]])), root(int(labels[y[n]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append(n)
        return pa.table({"a": nodes[x[kept]].astype(np.int64), "b": nodes[y[kept]].astype(np.int64)})

    return run


def _verified(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    left = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    return left.join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(_similar(threshold), "a long, b long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with __id (null as the smallest), __h1 and __h2 (128 bits of the text; null as empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """One row per different text: h1, h2, first (id, h1, h2 of its class), class_size."""
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col)
    base = keyed.select(F.col("__id").alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = base.mapInArrow(_signatures(size, bands, rows), "id long, h1 long, h2 long, weight long, bands array<long>")
    texts = keep(signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "weight", "bands")).alias("t"), F.count("*").alias("n"))
                 .select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "t.*"))

    places = texts.select("node", "weight", F.explode("bands").alias("key"))
    shared = places.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    members = keep(places.join(shared, "key"))
    wanted = members.select("node").distinct().join(texts.select("node", "id", "h1", "h2"), "node")
    items = keep(base.join(wanted, ["id", "h1", "h2"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(_shingle_lists(size), "node long, items binary"))

    hubs = members.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    near = components(_verified(hubs, items, threshold))

    # Buckets that still hold more than one component; of several with the same members, one.
    named = members.select("key", "node", "weight").join(near, "node", "left").withColumn("label", F.coalesce("label", "node"))
    same = [F.bit_xor(F.xxhash64("node", F.lit(n))).alias(f"s{n}") for n in (0, 1)]
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members"), *same).filter("x < y")
    mixed = mixed.groupBy("members", "s0", "s1").agg(F.min("key").alias("key")).select("key", "members")
    rest = keep(named.join(mixed, "key"))
    few = rest.filter(F.col("members") <= PAIRED)
    left, right = (few.select("key", F.col("node").alias(n), F.col("label").alias(f"{n}_label"), F.col("weight").alias(f"{n}_weight")) for n in ("a", "b"))
    across = left.join(right, "key").filter((F.col("a_label") < F.col("b_label")) & (F.least("a_weight", "b_weight") >= threshold * F.greatest("a_weight", "b_weight")))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = rest.filter(F.col("members") > PAIRED).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(items, "node")
    met = dealt.groupBy("key", "i", "j").applyInArrow(_block_links(threshold), "a long, b long")
    late = _verified(across.select("a", "b").distinct(), items, threshold).unionAll(met)

    # Later links join components, so only those are contracted once more.
    name = lambda n: near.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label"))
    late = late.join(name("a"), "a", "left").join(name("b"), "b", "left")
    joined = components(late.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    labels = texts.select("node", "h1", "h2", "id", "n").join(near, "node", "left").withColumn("near", F.coalesce("label", "node")).drop("label")
    labels = labels.join(joined.withColumnRenamed("node", "near"), "near", "left").withColumn("label", F.coalesce("label", "near"))
    classes = labels.groupBy("label").agg(F.min(F.struct("id", "h1", "h2")).alias("first"), F.sum("n").alias("class_size"))
    return labels.join(classes, "label").select("h1", "h2", "first", "class_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """The near-duplicate class of every row: `id_col`, class_id (smallest id of the class), class_size (rows in it).

    Classes are the connected components of links between texts whose weighted Jaccard similarity over shingles of
    `size` words is `threshold` or more. A pair of exactly that similarity is a candidate with probability
    1 - (1 - threshold**rows)**bands, 0.999997 with the defaults; candidates are compared exactly (32-bit shingle
    hashes). Texts without words are in a class only with equal texts; null counts as empty. Ids must be integers; a
    null id is kept and counts as the smallest, so the class_id of its class is null; repeated ids are allowed. Other
    columns are not read. Eager: tables are written to the shared folder when called.
    """
    found = _classes(docs, id_col, text_col, size, threshold, bands, rows)
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col).select(id_col, F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    return keyed.join(found, ["h1", "h2"]).select(F.col(id_col), F.when(F.col("first.id") != _NO_ID, F.col("first.id")).alias("class_id"), "class_size")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row of each near-duplicate class, that with the smallest id, with all its columns.

    If several texts of a class share that id, the one with the smallest hash stays; of rows equal in id and text, one.
    """
    found = _classes(docs, id_col, text_col, size, threshold, bands, rows)
    first = found.select(F.col("first.id").alias("__id"), F.col("first.h1").alias("__h1"), F.col("first.h2").alias("__h2")).distinct()
    key = ["__id", "__h1", "__h2"]
    return _keyed(docs, id_col, text_col).join(first, key, "left_semi").dropDuplicates(key).select(*docs.columns)
