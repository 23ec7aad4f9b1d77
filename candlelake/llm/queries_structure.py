"""Lines and conversations: the operators 11 to 13 bound to the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlelake.llm.conversation_repair import apply_repairs, digest_turns, plan_repairs
from candlelake.llm.line_dedup import drop_repeated_lines
from candlelake.llm.prefix_trie import numbered, prefix_trie, turn_ids
from candlelake.llm.queries import ORACLES, query, table
from candlelake.llm.shared import keep


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first h turns of conversation c - c % 5, then those of c behind its first h.

    Returns the turns (conv, depth, tid, bytes) and the conversations (conv); h is the checksum of c modulo 9.
    """
    rows = keep(numbered(turn_ids(turns)))
    lengths = rows.groupBy("conv").agg(F.count("*").alias("n"))
    c = F.col("conv")
    wanted = lengths.select("conv", (c - c % 5).alias("base"), (F.crc32(c.cast("string")) % 9).alias("h"))
    wanted = wanted.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    wanted = keep(wanted.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))))
    first = rows.filter("pos < 8").withColumnRenamed("conv", "base").join(wanted, "base").filter(F.col("pos") < F.col("taken"))
    own = rows.join(wanted, "conv").filter(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    parts = [df.select("conv", (F.col("pos") + 1).alias("depth"), "tid", "bytes") for df in (first, own)]
    return parts[0].unionAll(parts[1]), wanted.select("conv")


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf, "conversations")))


@query
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, i, line, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def _crc32(text: str) -> str:
    """The checksum in SQL: each byte is taken in, then eight bits are shifted out."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([CAST(ascii(substring({text}, CAST(i AS INTEGER), 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295)"


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults planted by the checksum of `conv_id:turn`."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies", "copy")


@query
def op13_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(turns)
    plans = keep(plan_repairs(rows))
    digests = digest_turns(apply_repairs(rows, plans))
    out = plans.join(digests.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    out = turns.select(F.col("conv_id").alias("all")).distinct().join(out, F.col("all").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("all").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _edits(arcs: dict[int, list[tuple[int, str, str]]]) -> str:
    """The least (cost, audit) of each of four roles, from those in the list `d`; arcs: (role before, cost, letters)."""
    one = lambda s, c, x: f"{{'c': d[{s + 1}].c + {c}, 'a': d[{s + 1}].a || {x}}}"
    return "[" + ", ".join("list_min([" + ", ".join(one(*a) for a in arcs[s]) + "])" for s in range(4)) + "]"


#: Inserts before a row: (role before, cost, letters) by the role after. 0 none yet, 1 system, 2 user, 3 assistant.
_INSERTS = {0: [(0, "0", "''")], 1: [(1, "0", "''")], 2: [(2, "0", "''"), (0, "2", "'I'"), (1, "2", "'I'"), (3, "2", "'I'")], 3: [(3, "0", "''"), (2, "2", "'I'"), (0, "4", "'II'"), (1, "4", "'II'")]}
_KEEP = lambda s, role: (s, f"(CASE WHEN free AND role = '{role}' THEN late ELSE 1000000000 END)", "'K'")
_SET = lambda s: (s, "(CASE WHEN free THEN 2 + late ELSE 1000000000 END)", "'R'")
_ROWS = {0: [(0, "3", "'D'")], 1: [(1, "3", "'D'"), _KEEP(0, "s")], 2: [(2, "3", "'D'"), *(_KEEP(s, "u") for s in (0, 1, 3)), *(_SET(s) for s in (0, 1, 3))], 3: [(3, "3", "'D'"), _KEEP(2, "a"), _SET(2)]}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BODY = f"rtrim(text, {_SPACES})"

ORACLES["op13_structure_repair"] = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
marked AS (SELECT *, {_crc32("name")} % 20 AS kind FROM named),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS name,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked),
placed AS (
  SELECT *, substring(name, 1, 1) AS role, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, name, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, text, copy)),
judged AS (
  SELECT *, CASE WHEN {_BODY} = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right({_BODY}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
steps AS (SELECT conv_id, i, role, fault IN (0, 3) AS free, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS late FROM judged),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i,
         [{{'c': CAST(0 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}, {{'c': CAST(1000000000 AS BIGINT), 'a': ''}}] AS d
  FROM ids
  UNION ALL
  SELECT conv_id, i, {_edits(_ROWS)} AS d
  FROM (SELECT w.conv_id, s.i, s.role, s.free, s.late, {_edits(_INSERTS).replace("d[", "w.d[")} AS d
        FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.i = w.i + 1)),
ends AS (
  SELECT conv_id, list_min([{{'c': d[1].c, 'a': d[1].a}}, {{'c': d[4].c, 'a': d[4].a}}, {{'c': d[3].c + 2, 'a': d[3].a || 'I'}},
         {{'c': d[2].c + 4, 'a': d[2].a || 'II'}}]) AS best
  FROM (SELECT conv_id, arg_max(d, i) AS d FROM walk GROUP BY conv_id)),
letters AS (
  SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS nr FROM ends WHERE best.a <> ''),
used AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nr) AS i FROM letters),
left_ AS (
  SELECT u.conv_id, nr, letter, j.name, j.text,
         sum(CASE WHEN letter = 'K' AND j.role = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY u.conv_id ORDER BY nr) AS nth
  FROM used u LEFT JOIN judged j ON j.conv_id = u.conv_id AND j.i = u.i AND letter <> 'I' WHERE letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN name WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY nr) AS body
  FROM left_ GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE before || role NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN ends USING (conv_id) LEFT JOIN counts USING (conv_id) LEFT JOIN texts USING (conv_id)"""


ORACLES["op11_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS bytes, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS tok,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations),
ids AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS b, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM conversations),
rebuilt AS (
  SELECT c, 0 AS part, pos, tok, bytes FROM ids JOIN turns t ON t.conv_id = b AND pos < h
  UNION ALL SELECT c, 1, pos, tok, bytes FROM ids JOIN turns t ON t.conv_id = c AND pos >= h),
seqs AS (
  SELECT c, coalesce(list(tok ORDER BY part, pos) FILTER (WHERE tok IS NOT NULL), []) AS s,
         coalesce(list(bytes ORDER BY part, pos) FILTER (WHERE tok IS NOT NULL), []) AS z
  FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
paths AS (SELECT c, s, z, unnest(range(0, len(s) + 1)) AS d FROM seqs),
nodes AS (
  SELECT s[1:d] AS k, d, min(c) AS conv, count(*) AS n, coalesce(max(z[d]), 0) AS bytes,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(s) = d), '') AS ends
  FROM paths GROUP BY s[1:d], d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
above AS (SELECT k AS low, n, bytes, d, unnest(range(0, d + 1)) AS up FROM nodes),
sums AS (
  SELECT low[1:up] AS k, sum((n - 1) * bytes) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves
  FROM above LEFT JOIN kids ON kids.k = low GROUP BY low[1:up])
SELECT x.conv AS conv_id, x.d AS depth, p.conv AS parent_conv_id, x.n AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON x.d > 0 AND p.k = x.k[1:x.d - 1]"""
