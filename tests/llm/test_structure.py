"""Line dedup, the prefix trie and structure repair against brute force, and every query with SQL against that."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from candlelake.llm import line_dedup, turns
from candlelake.llm.conversation_repair import apply_repairs, digest_turns, plan_repairs
from candlelake.llm.prefix_trie import numbered, prefix_trie, turn_ids
from candlelake.llm.queries_structure import damaged, rebuilt
from suite.compare import compare, connect

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", [n for n in queries() if n.startswith("op") and n in oracle_sql()])
def test_query_against_its_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries()[name], oracle_sql()[name]) == ""


# --- 12 ---

LINES = "doc_id bigint, text string, id string, key string, gone string, kept string, docs int"


def line_rows():
    rng = random.Random(3)
    often = ["  The SAME line, in many documents\t", "ÉCLAIR à la carte, encore une fois", "short line", "x" * 19, "y" * 20, "long " * 20_000]
    rows = []
    for i in range(60):
        lines = [rng.choice(often) if rng.random() < 0.5 else f"a line of its own, number {i} {rng.random()}" for _ in range(rng.randint(1, 5))]
        if i % 7 == 0:
            lines = [x.upper() + "\r" for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, often[0] + "\nnull id"), (None, often[4]), (5, rows[5][1]), (7, often[1] + "\n"), (61, "twice only, in two documents"), (62, "twice only, in two documents")]
    return rows


def brute_lines(rows, min_chars=20, min_docs=3):
    low = lambda i: -(1 << 63) if i is None else i
    key = lambda line: line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == low(i)]
        out.append((low(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 26, 8])
def test_lines(spark, size):
    """With a filter of 8 bytes, which is soon full, every line is suspected."""
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", 1) for i, t in rows], LINES).repartition(5)
    got = line_dedup.drop_repeated_lines(docs, max_filter_bytes=size).collect()
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).collect() == []
    two = line_dedup.drop_repeated_lines(docs, min_docs=2, min_chars=1).collect()
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in two) == brute_lines(rows, 1, 2)


def test_filters_lose_no_repeat():
    rng = np.random.default_rng(1)
    tasks = [rng.integers(0, 3000, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(6)]
    seen = collections.Counter(h for t in tasks for h in t.tolist())
    once, twice = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint64)
    for t in tasks:
        own = np.zeros_like(once), np.zeros_like(once)
        for part in np.array_split(t, 7):
            line_dedup.mark(part, *own)
        line_dedup.merge(once, twice, *own)
    value = np.array(list(seen), np.uint64)
    word, mask = line_dedup._places(value, len(once))
    hit = (twice[word] & mask) == mask
    repeated = np.array([seen[h] > 1 for h in value.tolist()])
    assert hit[repeated].all() and hit[~repeated].mean() < 0.05


# --- 13 ---


def brute_edits(roles, faults):
    """Cheapest and least by trying every edit, cheapest first."""
    import heapq

    heap, done = [(0, "", 0, 0)], {}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    legal = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = cost, audit
        if at == len(roles) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", at, after[state]))
        if at < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if faults[at] not in (1, 2):
                late = int(faults[at] == 3)
                heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, after[state]))
                if (state, roles[at]) in legal:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, roles[at]))


@pytest.mark.parametrize("block", [65_536, 3])
def test_edits(monkeypatch, block):
    monkeypatch.setattr(turns, "BLOCK", block)
    rng = random.Random(block)
    convs = [[(rng.randint(0, 3), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.choice([0, 1, 2, 5, 9, 17]))] for _ in range(150)]
    flat = [(r, f, n) for n, c in enumerate(convs) for r, f in c]
    cost, audit = turns.cheapest_edits(*(np.array(x) for x in zip(*flat, strict=True)), len(convs))
    for n, c in enumerate(convs):
        assert (int(cost[n]), audit[n].decode()) == brute_edits([r for r, _ in c], [f for _, f in c])


def test_least_path_where_letters_repeat():
    rng = random.Random(4)
    for _ in range(60):
        nodes = 9
        arcs = [(a, rng.randint(0, 1), b) for a, b in itertools.combinations(range(nodes), 2) if rng.random() < 0.4]

        def words(n, arcs=arcs):
            out = [() for _ in [0] if not any(a == n for a, _, _ in arcs)]
            return out + [(x, *w) for a, x, b in arcs if a == n for w in words(b)]

        starts = np.array([0, 3, 8])
        got = turns.least_paths(*(np.array(x, np.int64) for x in (zip(*arcs, strict=True) if arcs else ([], [], []))), nodes, starts)
        assert [tuple(p.tolist()) for p in got] == [min(words(int(s))) for s in starts]


TURNS = "conv_id bigint, turn bigint, role string, text string, conv string, key string, audit string, position int"


def turn_rows():
    rng = random.Random(9)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 5, 8])):
            role = rng.choice(["user", "assistant", "system", "tool", None])
            rows.append((c, rng.choice([t, t, t * 2, None]), role, rng.choice(["Yes.", "No", " \n", "", None, "Why? ", f"Text {t}!", "é. " * 30_000])))
    return rows + [(None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (-7, None, "user", "Hi."), (-7, None, "user", "Hi.")]


def key_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute_repairs(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, mine in convs.items():
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], key_of(m[1], m[2])))
        seen, faults = set(), []
        for _, r, x in mine:
            body = x.rstrip(SPACE)
            faults.append(1 if not body else 2 if (r, x) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((r, x))
        roles = [{"s": 1, "u": 2, "a": 3}.get(r[:1], 0) for _, r, _ in mine]
        known = [t for t, _, _ in mine if t is not None]
        cost, audit = brute_edits(roles, faults)
        left, state, at = [], 0, 0
        for e in audit:
            if e != "D":
                state = roles[at] if e == "K" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
                left.append((mine[at][1] if e == "K" else ["", "", "user", "assistant"][state]) + ":" + ("" if e == "I" else mine[at][2]))
            at += e != "I"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest() if left else None)
    return out


def test_repairs(spark):
    rows = turn_rows()
    table = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], TURNS).repartition(3)
    plans = plan_repairs(table)
    digests = {r.conv_id: r.repaired_sha256 for r in digest_turns(apply_repairs(table, plans)).collect()}
    got = {r.conv_id: (*r[1:], digests.get(r.conv_id)) for r in plans.collect()}
    assert got == brute_repairs(rows)
    assert plan_repairs(table.limit(0)).collect() == [] and apply_repairs(table.limit(0), plans.limit(0)).collect() == []


def test_a_long_conversation(spark, monkeypatch):
    """Longer than a block, with one text in a third of its turns, in several Arrow batches."""
    rows = [(1, t, "user" if t % 2 else "assistant", "again." if t % 3 == 0 else f"text {t}.") for t in range(70_000)]
    table = spark.createDataFrame(rows + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in plan_repairs(table).collect()}
    assert got[2].audit == "KK" and got[1].duplicate == sum(t % 3 == 0 for t in range(70_000)) - 2
    assert len(got[1].audit.replace("I", "")) == 70_000 and got[1].truncated == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b {t}?!") for c in range(12) for t in (0, 1, 5, None)] + [(3, 9, None, None)]
    got = collections.Counter(tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    expected = collections.Counter()
    for c, t, r, x in rows:
        kind, r, x = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20, " " if r is None else r, " " if x is None else x
        x = {1: "", 2: x.translate({ord(m): None for m in ".!?"})}.get(kind, x)
        expected[c, t, "user" if kind == 4 else r, x] += {0: 0, 3: 2}.get(kind, 1)
    assert got == +expected


# --- 11 ---


def brute_trie(seqs):
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    total = lambda n: len(members[n]) - 1

    def below(n):
        saved, leaves = total(n) * len(n[-1][1].encode()) if n else 0, int(not kids[n])
        for k in list(kids[n]):
            a, b = below(k)
            saved, leaves = saved + a, leaves + b
        return saved, leaves

    out = []
    for n, who in members.items():
        saved, leaves = below(n)
        ends = ",".join(str(c) for c in sorted(who) if seqs[c] == n)
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(kids[n]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 12, 16_384])
def test_trie(spark, size):
    rng = random.Random(2)
    rows = []
    for c in range(-3, 60):
        start = [("system", "You help."), ("user", "é" * rng.randint(1, 3))][: rng.randint(0, 2)]
        seq = start + [(rng.choice(["user", None]), rng.choice(["a", "b", None, "", "long " * 9_000])) for _ in range(rng.randint(0, 4))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(seq or [("user", "one")])]
    for c in range(60, 80):  # copies of one conversation
        rows += [(c, None, "user", "first"), (c, 1, "user", "copy"), (c, 2, "assistant", "copy")]
    rows += [(None, 1, "user", "lost"), (80, 1, "", "x"), (80, 1, "x", "")]
    table = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], TURNS).repartition(3)
    ids = numbered(turn_ids(table))
    lines = ids.selectExpr("conv", "pos + 1 AS depth", "tid", "bytes")
    members = lines.select("conv").distinct().unionAll(spark.createDataFrame([(500,), (501,)], "conv long"))
    seqs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            seqs[c].append((t, r or "", x or ""))
    order = lambda m: (m[0] is not None, m[0] or 0, key_of(m[1], m[2])[:16])
    seqs = {c: tuple((r, x) for _, r, x in sorted(s, key=order)) for c, s in seqs.items()} | {500: (), 501: ()}
    got = [tuple(r) for r in prefix_trie(lines, members, size).collect()]
    assert sorted(got, key=repr) == brute_trie(seqs)
    assert prefix_trie(lines.limit(0), members.limit(0)).collect() == []


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c // 7} {t}") for c in range(23) for t in range(c % 6)] + [(23, None, "user", "first"), (23, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found, members = rebuilt(table)
    own = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda m: (m[0], m[1] is not None, m[1] or 0)):
        own[c].append(key_of(r or "", x or "")[:16])
    expected = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        expected[c] = (own.get(c - c % 5, []))[:h] + mine[h:]
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.conv].append((r.depth, bytes(r.tid)))
    assert {r.conv for r in members.collect()} == set(expected)
    for c, seq in expected.items():
        assert sorted(got[c]) == list(enumerate(seq, 1))
