"""The trie of conversation prefixes, built as a burst trie.

A conversation is a sequence of turn ids. All start in the container under the root. A container whose sequences hold
more turns than a task should take bursts: its head becomes an inner node, and its sequences move to containers one turn
further on, by the id of their next turn. Only containers that are too large take part in the next round. What remains is
dealt out by head, sorted, and swept once: a sequence opens nodes behind the prefix that it shares with the one before.

Equal sequences are one sequence with several members, so copies neither fill a container nor keep it from bursting. What
a container finds is added to the inner nodes above it along its list of heads, in one aggregate for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlelake.llm.shared import keep

Batches = Iterator[pa.RecordBatch]

_NOBODY = hashlib.sha256(b"").hexdigest()
_NODE = "conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string, top boolean, path array<binary>"
_SCHEMA = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("top", pa.bool_()), ("path", pa.list_(pa.binary()))])


def turn_ids(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv, turn, tid (128 bits of role and text), bytes (of the text); null role or text is empty, rows without id go."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    tid = F.unhex(F.substring(F.sha2(name, 256), 1, 32))
    return turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col("turn").alias("turn"), tid.alias("tid"), F.octet_length(text).cast("long").alias("bytes"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of `turn_ids` with `pos`, from 0 on in each conversation by turn (null first), then turn id.

    A sort over all rows cuts a long conversation anywhere; each cut piece learns how many rows lie before it.
    """
    order = ("conv", F.col("turn").asc_nulls_first(), "tid")
    placed = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("piece", F.shiftright("at", 33))
    pieces = placed.groupBy("conv", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv", "piece", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(pieces, ["conv", "piece"]).select("conv", "tid", "bytes", (F.col("at") - F.col("first") + F.col("before")).alias("pos"))


def _members(batches: Batches) -> Batches:
    """For each run of equal sequences: members, the least of them, and the digest of their ids."""
    schema = pa.schema([("sid", pa.binary()), ("conv", pa.int64()), ("members", pa.int64()), ("ends", pa.string())])
    sid, first, count, digest = None, 0, 0, hashlib.sha256()
    for batch in batches:
        out = []
        for name, conv in zip(batch.column("sid").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if name != sid:
                if count:
                    out.append({"sid": sid, "conv": first, "members": count, "ends": digest.hexdigest()})
                sid, first, count, digest = name, conv, 0, hashlib.sha256()
            digest.update(f",{conv}".encode() if count else str(conv).encode())
            count += 1
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if count:
        yield pa.RecordBatch.from_pylist([{"sid": sid, "conv": first, "members": count, "ends": digest.hexdigest()}], schema=schema)


def sweep(rows: list[dict]) -> list[dict]:
    """The nodes of one container, its head first, from its sequences in order."""
    depth = rows[0]["depth"]
    nodes: list[dict] = []
    stack: list[int] = []
    before: list[bytes] = []

    def opened(at: int, size: int) -> None:
        nodes.append({"conv": None, "depth": at, "up": stack[-1] if stack else -1, "n_convs": 0, "n_children": 0, "n_leaves": 0, "bytes": size, "ends": _NOBODY})
        if stack:
            nodes[stack[-1]]["n_children"] += 1
        stack.append(len(nodes) - 1)

    opened(depth, rows[0]["sizes"][depth - 1] if depth else 0)
    for row in rows:
        tids, shared = row["tids"], depth
        while shared < len(before) and shared < len(tids) and tids[shared] == before[shared]:
            shared += 1
        del stack[shared - depth + 1 :]
        for at in range(shared, len(tids)):
            opened(at + 1, row["sizes"][at])
        for n in stack:
            node = nodes[n]
            node["n_convs"] += row["members"]
            node["conv"] = row["conv"] if node["conv"] is None else min(node["conv"], row["conv"])
        nodes[stack[-1]]["ends"] = row["ends"]
        before = tids
    for node in nodes:
        node["saved"] = (node["n_convs"] - 1) * node["bytes"]
        node["n_leaves"] = int(node["n_children"] == 0)
    for node in reversed(nodes):  # children stand behind their parent
        if node["up"] >= 0:
            parent = nodes[node["up"]]
            parent["saved"] += node["saved"]
            parent["n_leaves"] += node["n_leaves"]
            node["parent"] = parent["conv"]
    nodes[0] |= {"parent": None, "top": True, "path": rows[0]["path"]}
    return nodes


def _swept(batches: Batches) -> Batches:
    held: list[dict] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and held[0]["head"] != row["head"]:
                out += sweep(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_pylist([{"top": False, "path": None} | n for n in out], schema=_SCHEMA)
    if held:
        yield pa.RecordBatch.from_pylist([{"top": False, "path": None} | n for n in sweep(held)], schema=_SCHEMA)


def _burst(rows: DataFrame, container_turns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled containers, inner nodes (head, depth, path, bytes), and the sequences that end at an inner node."""
    length = F.size("tids")
    last = F.when(F.col("depth") > 0, F.get("sizes", F.col("depth") - 1)).otherwise(0)
    settled, inner, stays = [], [], []
    while True:
        weights = rows.groupBy("head").agg(F.count("*").alias("m"), F.sum(length - F.col("depth")).alias("w"), F.first("depth").alias("depth"), F.first("path").alias("path"), F.first(last).alias("bytes"))
        large = keep(weights.filter((F.col("m") > 1) & (F.col("w") > container_turns)).select("head", "depth", "path", "bytes"))
        if large.isEmpty():
            settled.append(rows)
            break
        inner.append(large)
        marked = keep(rows.join(large.select("head", F.lit(True).alias("large")), "head", "left"))
        settled.append(marked.filter("large is null").drop("large"))
        going = marked.filter("large").drop("large").withColumn("path", F.array_append("path", F.col("head")))
        stays.append(going.filter(length == F.col("depth")).select("head", "path", "members", "conv", "ends"))
        onward = going.filter(length > F.col("depth"))
        rows = onward.withColumns({"head": F.unhex(F.md5(F.concat("head", F.get("tids", F.col("depth"))))), "depth": F.col("depth") + 1})

    def all_of(parts: list[DataFrame], none: DataFrame) -> DataFrame:
        out = none
        for part in parts:
            out = out.unionByName(part) if out is not none else part
        return out

    first = settled[0].limit(0)
    none_inner = first.select("head", "depth", "path", last.alias("bytes"))
    return all_of(settled, first), all_of(inner, none_inner), all_of(stays, first.select("head", "path", "members", "conv", "ends"))


def prefix_trie(turns: DataFrame, members: DataFrame, container_turns: int = 16_384) -> DataFrame:
    """One row per node of the trie of conversation prefixes, from the textless root (depth 0) down.

    `turns` has conv, depth (1, 2, ... in each conversation), tid and bytes (see `turn_ids`); `members` has the column
    conv with every conversation, even one without turns. Ids are integers, null ids are not looked at. Columns: conv_id
    (smallest member, a conversation that starts with the node), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves, saved_tokens (over the subtree, members but one times the bytes of the last text), ends_sha256 (of the ids,
    ascending and joined by commas, of the members that end there). No members, no rows.

    A container holds up to `container_turns` turns below its head, or one sequence; a task sweeps a container at a time.
    A conversation travels as one row of 24 bytes a turn. Eager: rounds of bursting write to the shared folder.
    """
    at = F.sort_array(F.collect_list(F.struct("depth", "tid", "bytes")))
    empty = F.array().cast("array<struct<depth:bigint,tid:binary,bytes:bigint>>")
    all_turns = turns.select("conv", F.col("depth").cast("long"), "tid", "bytes").groupBy("conv").agg(at.alias("turns"))
    found = members.filter("conv is not null").select("conv").distinct().join(all_turns, "conv", "left").withColumn("turns", F.coalesce("turns", empty))
    whole = keep(found.select("conv", F.col("turns.tid").alias("tids"), F.col("turns.bytes").alias("sizes")).withColumn("sid", F.unhex(F.sha2(F.array_join(F.transform("tids", F.hex), ""), 256))))
    same = whole.select("sid", "conv").repartition("sid").sortWithinPartitions("sid", "conv").mapInArrow(_members, "sid binary, conv long, members long, ends string")
    rows = keep(whole.join(same, ["sid", "conv"]).select(F.unhex(F.md5(F.lit(""))).alias("head"), F.lit(0).alias("depth"), F.array().cast("array<binary>").alias("path"), "tids", "sizes", "members", "conv", "ends"))

    settled, inner, stays = _burst(rows, container_turns)
    ordered = settled.repartition("head").sortWithinPartitions("head", "tids")
    nodes = keep(ordered.mapInArrow(_swept, _NODE))

    tops = nodes.filter("top")
    below = tops.select(F.col("path").alias("heads"), "n_convs", "conv", "n_leaves", "saved").unionAll(
        stays.select("path", "members", "conv", F.lit(0).cast("long"), F.lit(0).cast("long")))
    sums = below.select(F.explode("heads").alias("head"), "n_convs", "conv", "n_leaves", "saved").groupBy("head").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
    parent = F.element_at("path", -1)
    heads = keep(inner.join(sums, "head"))
    own = heads.select(F.explode(F.array_append("path", F.col("head"))).alias("head"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own")).groupBy("head").agg(F.sum("own").alias("own"))
    children = tops.filter(F.size("path") > 0).select(parent.alias("head")).unionAll(heads.filter(F.size("path") > 0).select(parent.alias("head"))).groupBy("head").agg(F.count("*").alias("n_children"))
    full = heads.join(own, "head").join(children, "head").join(stays.select("head", "ends"), "head", "left")
    upper = full.select("conv", F.col("depth").cast("long").alias("depth"), "n_convs", "n_children", "n_leaves", (F.col("below") + F.col("own")).alias("saved"), F.coalesce("ends", F.lit(_NOBODY)).alias("ends"), "path")
    upper = upper.unionByName(tops.select(upper.columns))
    names = heads.select(F.col("head").alias("up"), F.col("conv").alias("parent"))
    upper = upper.withColumn("up", F.when(F.size("path") > 0, parent)).join(names, "up", "left")
    shown = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    out = nodes.filter("not top").select(shown).unionAll(upper.select(shown))
    return out.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
