"""Toxicity by compression distance between two zstandard dictionaries.

The ordinary dictionary is trained by zstandard on windows of ordinary text. The toxic dictionary has the same content,
since toxic documents are mostly ordinary language, followed by the strings that set toxic documents apart: word
beginnings and whole words that many toxic and hardly any ordinary documents hold. Every window of a text is compressed
with both; a window that the toxic dictionary shortens by some bytes holds such a string. How the shortenings of a
document are spread, against its number of windows, is turned into a probability by a logistic curve fitted to labelled
documents. All of this reads the text in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

WINDOW, STEP = 64, 48
#: Longest string of the toxic dictionary; windows overlap by as much, so each occurrence is whole in one of them.
LONGEST = WINDOW - STEP
#: Shortenings of this many bytes or more count alike; those below LEAST are noise.
LEAST, MOST = 3, 15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PREFIXES = (4, 5, 6, 8)
_NO_DICTIONARY = b"ordinary"


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        plan = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, hash_log=15, chain_log=15, search_log=4, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        both = (zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in (self.ordinary, self.ordinary + self.toxic))
        ordinary, toxic = (zstandard.ZstdCompressor(dict_data=d, compression_params=plan) for d in both)
        return ordinary, toxic

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


def lower(body: bytes) -> bytes:
    """The text in lower case, letters beyond ASCII too."""
    return body.decode("utf-8", "replace").lower().encode()


def windows(body: bytes) -> list[bytes]:
    """The whole text in overlapping windows; a text shorter than one is a window by itself."""
    return [body[a : a + WINDOW] for a in range(0, max(1, len(body) - LONGEST), STEP)]


def features(bodies: list[bytes], compressors: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    """Largest shortening, sum of the three largest, number of windows, and counts and shares of windows by shortening."""
    plain, toxic = (c.compress for c in compressors)
    out = np.zeros((len(bodies), 3 + 2 * (MOST + 1 - LEAST)))
    for row, body in zip(out, bodies, strict=True):
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(lower(body))])
        spread = np.bincount(np.clip(saved, 0, MOST), minlength=MOST + 1)[LEAST:]
        row[0], row[1], row[2] = saved.max(), np.sort(saved)[-3:].sum(), np.log1p(len(saved))
        row[3 : 3 + len(spread)], row[3 + len(spread) :] = np.log1p(spread), spread / len(saved)
    return out


def _units(word: bytes) -> set[bytes]:
    whole = word + b" "
    return {word[:n] for n in _PREFIXES if len(word) > n} | ({whole} if len(whole) < LONGEST else set())


def _frequencies(texts: list[bytes]) -> Counter[bytes]:
    counts: Counter[bytes] = Counter()
    for text in texts:
        counts.update(set().union(*map(_units, set(_WORD.findall(lower(text))))))
    return counts


def telling_strings(toxic: list[bytes], ordinary: list[bytes], share: float, ratio: float) -> list[bytes]:
    """Strings in at least `share` of the toxic texts (4 at least) and `ratio` times rarer in ordinary ones, rarest first.

    A string goes if a longer one is nearly as frequent, or if a shorter one covers it and is clearly more frequent.
    """
    here, there = _frequencies(toxic), _frequencies(ordinary)
    floor = max(4.0, share * len(toxic))
    found = {u: n for u, n in here.items() if n >= floor and (n + 0.5) / (len(toxic) + 1) > ratio * (there[u] + 0.5) / (len(ordinary) + 1)}
    kept = []
    for u, n in found.items():
        longer = any(v != u and v.startswith(u) and m >= 0.8 * n for v, m in found.items())
        shorter = any(v != u and u.startswith(v) and m > n / 0.8 for v, m in found.items())
        if not longer and not shorter:
            kept.append((n, u))
    return [u for _, u in sorted(kept)]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * np.append(0, w[1:]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 2000, sample_bytes: int = 100_000, dictionary_bytes: int = 16_384, share: float = 0.02, ratio: float = 20.0) -> ToxicityModel:
    """Train on at most about `sample_docs` labelled documents of each label, chosen by a hash of their id.

    Documents of more than `sample_bytes` bytes are scored like all others, but not trained on: the sample is what comes
    to the driver, so it is bounded in rows and in bytes. All of it trains the model. Equal texts count once. Null labels,
    and labels without a document, are left out. With fewer than two labels in the sample all scores are its share of label 1, or 0.5 if it is empty.
    """
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct()
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1_000_000))
    chosen = None
    for label, n in sorted(sizes.items()):
        part = known.filter((F.col("__label") == label) & (place < int(1_000_000 * min(1.0, sample_docs / n)))).orderBy(place, "__id").limit(2 * sample_docs)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts: dict[bytes, int] = {}
    if chosen is not None:
        # Bounded by the limits above, so it is broadcast and the documents are not shuffled.
        rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "__id")
        for r in sorted(((r["text"].encode(), int(r["__label"] > 0)) for r in rows.select("text", "__label").collect()), reverse=True):
            texts.setdefault(*r)
    toxic, ordinary = ([t for t, y in texts.items() if y == label] for label in (1, 0))
    width = 3 + 2 * (MOST + 1 - LEAST)
    if not toxic or not ordinary:
        odds = (len(toxic) + 0.5) / (len(ordinary) + 0.5) if texts else 1.0
        return ToxicityModel(_NO_DICTIONARY, b"", (0.0,) * width, (1.0,) * width, (float(np.log(odds)), *(0.0,) * width))
    pieces = [t[a : a + 2 * WINDOW] for t in map(lower, ordinary) for a in range(0, len(t), 2 * WINDOW)]
    try:
        base = zstandard.train_dictionary(dictionary_bytes, pieces, level=3).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        base = b"".join(pieces)[:dictionary_bytes] or _NO_DICTIONARY
    told = b"".join(b" " + u for u in telling_strings(toxic, ordinary, share, ratio))
    untrained = ToxicityModel(base, told, (), (), ())
    order = sorted(texts)
    x = features(order, untrained.compressors())
    mean, scale, weights = _fit(x, np.array([texts[t] for t in order]))
    return ToxicityModel(base, told, tuple(mean.tolist()), tuple(scale.tolist()), tuple(weights.tolist()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Adds `score`, the probability of label 1, to every row; whole texts are read, null and empty ones as one window.

    An input column called score is replaced. Rows are scored one by one, so repeated rows score alike.
    """
    others = [c for c in docs.columns if c not in ("score",)]
    place = others.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Batches) -> Batches:
        both = model.compressors()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                bodies = [(t or "").encode() for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(features(bodies, both)))], names=[*others, "score"])

    return docs.select(others).mapInArrow(run, f"{schema}, score double")
