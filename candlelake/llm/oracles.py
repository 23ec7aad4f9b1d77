"""SQL for those queries of the subpackage whose results plain SQL gives: all windows, all pairs, regular expressions."""

ORACLES: dict[str, str] = {}

# Every 400-byte window of every text, in hex; windows seen twice cover what goes.
ORACLES["op1_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(n - 399)) AS u(i)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w SEMI JOIN again USING (k)),
run AS (SELECT doc_id, i, sum(CASE WHEN b IS NULL OR i > b + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM span),
cut AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS front
        FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

# All pairs that share a shingle, their weighted Jaccard similarity, and the components of those of 0.8 or more.
ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s, count(*) AS n
      FROM w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) AS u(i) GROUP BY ALL),
z AS (SELECT id, sum(n) AS size FROM s GROUP BY id),
pair AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS common FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE common >= 0.8 * (x.size + y.size - common)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT id, id FROM t UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
label AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size
FROM documents JOIN t ON t.text = coalesce(documents.text, '') JOIN label USING (id)"""

# The same shares, hash order and running sums, over one window a source.
ORACLES["op3_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END || chr(10) || coalesce(text, '')) AS k FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
p AS (SELECT source, source_size, CAST(CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
      CAST(CASE turn WHEN 0 THEN 1.5 WHEN 1 THEN 1 ELSE 0.5 END AS DOUBLE) AS t0, CAST(CASE turn WHEN 0 THEN 0.5 WHEN 1 THEN 1 ELSE 1.5 END AS DOUBLE) AS t1,
      source_size * CAST(3 AS DOUBLE) AS cap FROM g),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER (ORDER BY cap / weight) AS capped, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight) AS others FROM p),
f AS (SELECT *, capped + cap / weight * others <= total AS is_full FROM l),
x AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS used, sum(weight) FILTER (NOT is_full) OVER () AS free FROM f),
target AS (SELECT source, source_size, t0, t1, CASE WHEN is_full THEN cap ELSE least(cap, (total - used) * weight / free) END AS target FROM x),
unit AS (SELECT source, k, any_value(size) AS size, count(*) AS n FROM d GROUP BY source, k),
placed AS (SELECT unit.*, source_size, t0, t1, target, CAST(size * n AS DOUBLE) AS words,
           coalesce(sum(size * n) OVER (PARTITION BY unit.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM unit JOIN target ON target.source IS NOT DISTINCT FROM unit.source),
turns AS (SELECT *, CAST(least(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END, 3) AS BIGINT) AS rounds FROM placed),
part AS (SELECT *, CASE WHEN rounds < 3 THEN CAST(floor(greatest(least(floor(greatest(target - rounds * source_size, 0)) - before, words), 0) / n) AS BIGINT) ELSE 0 END AS extra,
         least(CAST(before AS DOUBLE) / greatest(target, 1), 1) AS done FROM turns)
SELECT doc_id, part.size, source_size, target, CASE WHEN part.size > 0 THEN rounds * part.size + extra ELSE 0 END AS taken,
       CASE WHEN part.size > 0 AND (rounds > 0 OR extra > 0) THEN
         CASE WHEN t0 = t1 THEN done ELSE (sqrt(greatest(t0 * t0 + 2 * (t1 - t0) * done * ((t0 + t1) / 2), 0)) - t0) / (t1 - t0) END END AS position
FROM d JOIN part ON part.k = d.k AND part.source IS NOT DISTINCT FROM d.source"""

# Sizes of the rendered conversation follow from the template: a backslash for each control string, a mark around each part.
ORACLES["op5_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, len(regexp_extract_all(role, '[<\[]\\*(?:s>|/s>|INST\]|/INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(?:s>|/s>|INST\]|/INST\])')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(17 + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLES["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest(range(5)) AS u(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 2 * n_symbols <= n_words AND word_chars >= 2 * n_words AND word_chars <= 25 * n_words AND 2 * n_dup_lines <= n_lines AS kept
FROM b"""
