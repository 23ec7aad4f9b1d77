"""Secrets in texts: named patterns, and strings that a character Markov model holds for random. DataFrame functions only.

The patterns find secrets that announce themselves. Their values, from a bounded sample of documents, are also the
labelled examples of random strings; the other words of the same sample are the examples of ordinary identifiers. Two
first-order character models are fitted to them, and a long word with a letter is a secret if the mean
log-likelihood ratio of its characters is above a threshold. Everything is evaluated row by row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, with patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_WORD = "[A-Za-z0-9+/_=-]"
_SPAN = "array<struct<s:int,k:int,e:int>>"
#: Characters of a word that the examples of ordinary identifiers are drawn from.
_ORDINARY = rf"{_WORD}{{4,}}"


@dataclass(frozen=True)
class SecretModel:
    """`ratio[i * n + j]`: log-likelihood ratio of character j after character i, random against ordinary."""

    ratio: tuple[float, ...]
    threshold: float = 1.5
    least: int = 12

    def candidates(self) -> str:
        """Whole words of at least `least` characters with a letter."""
        return rf"(?<!{_WORD})(?=[0-9+/_=-]*[A-Za-z]){_WORD}{{{self.least},}}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Matches whose lengths are added up one by one; longer lists are added up block by block.
_BLOCK = 64


def _spans(text: str, pattern: str, kind: int, good: str = "true") -> str:
    """Spans of the matches of a pattern that are `good` (a condition on the match w), as SQL.

    A match ends where the texts before and between the matches, and the matches so far, add up to.
    """
    added = lambda parts: f"aggregate({parts}, 0, (sum, part) -> sum + part)"
    sizes = "transform(m, (w, i) -> char_length(element_at(p, i + 1)) + char_length(w))"
    blocks = f"transform(sequence(0, cast((size(v) - 1) DIV {_BLOCK} AS INT)), j -> slice(v, j * {_BLOCK} + 1, {_BLOCK}))"
    ends = f"flatten(transform(b, (x, j) -> {_let('o', added('slice(t, 1, j)'), f'transform(x, (y, i) -> o + {added("slice(x, 1, i + 1)")})')}))"
    spans = f"transform(c, (e, i) -> named_struct('s', e - char_length(element_at(m, i + 1)), 'k', {kind}, 'e', e, 'w', element_at(m, i + 1)))"
    kept = f"transform(filter({spans}, x -> {_let('w', 'x.w', good)}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    placed = _let("p", f"split({text}, {_quoted(pattern)}, -1)", _let("v", sizes, _let("b", blocks, _let("t", f"transform(b, x -> {added('x')})", _let("c", ends, kept)))))
    return _let("m", f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", f"CASE WHEN size(m) = 0 THEN cast(array() AS {_SPAN}) ELSE {placed} END")


def _piece(text: str, span: str = "x") -> str:
    return f"substring({text}, {span}.s + 1, {span}.e - {span}.s)"


def base_spans(text: str) -> Column:
    """Spans (s, k, e) of the named patterns in a column, ordered; code points, end exclusive."""
    assign = _spans(text, ASSIGN, 0, f"char_length(regexp_extract(w, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}")
    access = _spans(text, ACCESS, 1, f"char_length(w) >= {ACCESS_LEAST}")
    # Runs are maximal, so short ones can be left out in the pattern itself.
    hexes = _spans(text, HEX.replace("+", f"{{{HEX_LEAST},}}"), 2)
    return F.expr(f"array_sort(concat({assign}, {access}, {hexes}))")


def markov_spans(text: str, base: str, model: SecretModel) -> Column:
    """Spans of random words that touch no base span."""
    n = len(ALPHABET)
    table = "array(" + ",".join(f"{x:.6f}D" for x in model.ratio) + ")"
    code = lambda i: f"locate(substring(w, {i}, 1), '{ALPHABET}')"
    mean = f"aggregate(sequence(2, char_length(w)), 0D, (a, i) -> a + element_at({table}, ({code('i - 1')} - 1) * {n} + {code('i')})) / (char_length(w) - 1)"
    free = f"NOT exists({base}, b -> b.s < x.e AND x.s < b.e)"
    return F.expr(f"filter({_spans(text, model.candidates(), 3, f'{mean} >= {model.threshold}D')}, x -> {free})")


def train_secret_model(docs: DataFrame, text_col: str = "text", sample_rows: int = 4000, smoothing: float = 0.5, threshold: float = 1.5, least: int = 12) -> SecretModel:
    """Fit the model to about `sample_rows` documents, chosen by a hash of their text.

    Label 1: the values of the named patterns; label 0: every other word of four or more characters. The counts of
    character pairs, at most len(ALPHABET) ** 2 per label, come to the driver. A pair that was never seen has `smoothing`
    counts, so without any example random strings are taken as uniform.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    cut = int(share * 1_000_000)
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < cut)
    found = sample.withColumn("base", base_spans("text"))
    value = F.expr(f"transform(base, x -> CASE WHEN x.k = 0 THEN regexp_extract({_piece('text')}, {_quoted(ASSIGN)}, 2) ELSE {_piece('text')} END)")
    secret = found.filter(F.size("base") > 0).select(F.lit(1).alias("label"), F.explode(F.array_distinct(value)).alias("word"))
    ordinary = found.filter(F.size("base") == 0).select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all("text", F.lit(_ORDINARY), F.lit(0))).alias("word"))
    pairs = secret.unionAll(ordinary).filter(F.length("word") > 1).select("label", F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    ratio = []
    for a in ALPHABET:
        given = [{b: counts.get((label, a + b), 0) + smoothing for b in ALPHABET} for label in (0, 1)]
        sums = [sum(x.values()) for x in given]
        ratio += [math.log(given[1][b] / sums[1]) - math.log(given[0][b] / sums[0]) for b in ALPHABET]
    return SecretModel(tuple(ratio), threshold, least)


def _scanned(docs: DataFrame, model: SecretModel, text_col: str, base: str, secrets: str) -> DataFrame:
    text = "__scanned"
    out = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(base, base_spans(text))
    return out.withColumn(secrets, F.array_sort(F.concat(base, markov_spans(text, base, model)))).drop(text)


def scan_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """Adds `base` (spans of the named patterns) and `secrets` (those and the model's), ordered by start, kind, end.

    A span is (s: first code point, k: number in KINDS, e: code point after the last). Null and empty texts have none, an
    empty table stays empty. Input columns named base or secrets are replaced; no row is dropped or repeated.
    """
    return _scanned(docs.drop("base", "secrets"), model, text_col, "base", "secrets")


def span_text(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at({names}, x.k + 1), x.s, x.e)), ',')")


def redact_secrets(docs: DataFrame, model: SecretModel, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns kept, with every secret replaced by `mark`; spans that overlap are replaced as one."""
    t = f"coalesce(`{text_col}`, '')"
    step = (
        f"(acc, x) -> CASE WHEN x.e <= acc.at THEN acc WHEN x.s < acc.at THEN named_struct('at', x.e, 'out', acc.out) "
        f"ELSE named_struct('at', x.e, 'out', concat(acc.out, substring({t}, acc.at + 1, x.s - acc.at), {_quoted(mark)})) END"
    )
    done = f"aggregate(__secrets, named_struct('at', 0, 'out', ''), {step}, acc -> concat(acc.out, substring({t}, acc.at + 1)))"
    scanned = _scanned(docs, model, text_col, "__base", "__secrets")
    return scanned.withColumn(text_col, F.when(F.size("__secrets") > 0, F.expr(done)).otherwise(F.col(text_col))).select(*docs.columns)
