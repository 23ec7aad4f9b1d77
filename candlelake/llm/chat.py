"""Conversations as token sequences with a loss mask, and the way back.

A turn is [INST] role [/INST] text </s>, and <s> opens a conversation. The four marks are reserved ids beyond the
vocabulary, spliced between segments that are encoded separately, so no text can produce one. Where a text holds the
string of a mark, a backslash is put after its first character (one more if there are some already), which is undone
by taking one out; so the rendered string can be split at the marks as well.

Turns are encoded one by one, wherever they lie. Only then are they brought together by conversation, and a
conversation of any length passes through its task as a stream of turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

# The marks, in the order of their reserved ids.
MARKS = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, CLOSE, HEAD, BODY = range(4)
_PLAIN = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])(\\*)\\(s>|/s>|INST\]|/INST\])")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Template:
    """A public byte-level vocabulary (a file of the `tokenizers` library) with the marks as ids after its last."""

    _loaded: dict[str, "Template"] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()

    @classmethod
    def load(cls, path: str) -> "Template":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def decode_all(self, pieces: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(pieces, skip_special_tokens=False) if pieces else []

    def turns(self, roles: list[list[int]], texts: list[list[int]], learned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some turns one after the other, their bounds, and the mask.

        The mask is the running sum of +1 where a learned segment begins and -1 where it ends.
        """
        head, body, close = ([self.first + mark] for mark in (HEAD, BODY, CLOSE))
        ids = np.fromiter(chain.from_iterable(chain(head, r, body, t, close) for r, t in zip(roles, texts, strict=True)), np.int32)
        role_size, text_size = (np.array([len(x) for x in c], np.int64) for c in (roles, texts))
        bounds = np.concatenate(([0], np.cumsum(role_size + text_size + 3)))
        begin = bounds[:-1] + 2 + role_size
        edge = np.zeros(len(ids) + 1, np.int8)
        np.add.at(edge, begin[learned], 1)
        np.add.at(edge, (begin + text_size)[learned], -1)
        return ids, bounds, np.cumsum(edge[:-1], dtype=np.int8)

    def parts(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(mark, places of the ids that follow it) for every mark in a sequence."""
        at = np.flatnonzero(ids >= self.first)
        return [(int(ids[a]) - self.first, np.arange(a + 1, b)) for a, b in zip(at, [*at[1:], len(ids)], strict=True)]

    def render(self, ids: np.ndarray) -> str:
        return "".join(MARKS[mark] + self.decode(ids[places].tolist()) for mark, places in self.parts(ids))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column one after the other, and their bounds."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]


def _list_column(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _encode(path: str, learned_role: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        template = Template.load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                roles, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("role", "text"))
                names = sorted(set(roles))
                named = dict(zip(names, template.encode([escape(x) for x in names]), strict=True))
                learned = np.array([r == learned_role for r in roles], bool)
                ids, bounds, mask = template.turns([named[r] for r in roles], template.encode([escape(x) for x in texts]), learned)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), part.column("turn"), part.column("tie"), _list_column(ids, bounds), _list_column(mask, bounds)],
                    names=["conv", "turn", "tie", "ids", "mask"])

    return run


def _assemble(path: str) -> Callable[[Batches], Batches]:
    """Opens each conversation and numbers its tokens; rows come ordered by conversation and turn."""

    def run(batches: Batches) -> Batches:
        opening = Template.load(path).first + OPEN
        before, place, offset = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column("conv").to_pylist()
            (ids, bounds), (mask, _) = _lists(batch.column("ids")), _lists(batch.column("mask"))
            fresh = np.array([a != b for a, b in zip(convs, [before, *convs[:-1]], strict=True)], bool)
            ids, mask = np.insert(ids, bounds[:-1][fresh], opening), np.insert(mask, bounds[:-1][fresh], 0)
            bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) + fresh)))
            # The row its conversation begins with; -1 where that lies in a batch before this one.
            row = np.arange(len(convs))
            begin = np.maximum.accumulate(np.where(fresh, row, -1))
            places = np.where(begin < 0, place + row, row - begin)
            offsets = np.where(begin < 0, offset + bounds[:-1], bounds[:-1] - bounds[begin])
            before, place, offset = convs[-1], int(places[-1]) + 1, int(offsets[-1] + bounds[-1] - bounds[-2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), pa.array(places, pa.int64()), pa.array(offsets, pa.int64()), _list_column(ids, bounds), _list_column(mask, bounds)],
                names=["conv", "turn", "place", "token_offset", "ids", "loss_mask"])

    return run


def format_conversations(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned_role: str = "assistant") -> DataFrame:
    """One row per turn: `conv_col`, `turn_col`, place (0, 1, ...), token_offset in its conversation, ids, loss_mask.

    Rows of a conversation are next to each other in one partition, in order, so joined they are its token sequence.
    `loss_mask` is 1 on the text of `learned_role` turns and 0 on all marks and other text. Turns are ordered by number,
    null first, then by role and text; repeated rows are repeated turns. Null roles and texts are empty; a null
    conversation id is a conversation of its own. Other columns are not read.
    """
    conv, turn = (turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.struct(F.col(role_col).alias("r"), F.xxhash64(text_col).alias("h")).alias("tie"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    encoded = rows.mapInArrow(_encode(tokenizer, learned_role), f"conv {conv}, turn {turn}, tie struct<r:string,h:bigint>, ids array<int>, mask array<tinyint>")
    ordered = encoded.repartition("conv").sortWithinPartitions("conv", "turn", "tie")
    out = ordered.mapInArrow(_assemble(tokenizer), f"conv {conv}, turn {turn}, place long, token_offset long, ids array<int>, loss_mask array<tinyint>")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def _digests(path: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        template = Template.load(path)
        now, done, state = object(), [], None

        def close() -> None:
            if state:
                n, turns, loss, loss_chars, chars = state
                done.append({"conv": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})

        for part in (batch.slice(a, 1000) for batch in batches for a in range(0, batch.num_rows, 1000)):
            convs = part.column("conv").to_pylist()
            (ids, bounds), (mask, _) = _lists(part.column("ids")), _lists(part.column("loss_mask"))
            # Every row begins with a mark, so the segments after marks never cross rows.
            at = np.flatnonzero(ids >= template.first)
            ends = np.append(at[1:], len(ids))
            marked = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            pieces = template.decode_all([ids[a + 1 : b].tolist() for a, b in zip(at, ends, strict=True)])
            for a, b, row, piece in zip(at.tolist(), ends.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), pieces, strict=True):
                mark = int(ids[a]) - template.first
                if mark == OPEN:
                    close()
                    now, state = convs[row], [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                state[4] += len(MARKS[mark]) + len(piece)
                if mark in (HEAD, BODY):
                    text = unescape(piece)
                    state[1].update((text + "\n").encode())
                if mark == BODY:
                    state[0] += 1
                    n = marked[b] - marked[a + 1]
                    learned = text if n == b - a - 1 else unescape(template.decode(ids[a + 1 : b][mask[a + 1 : b] > 0].tolist()))
                    state[2].update(learned.encode())
                    state[3] += len(learned)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return run


def conversation_digests(formatted: DataFrame, tokenizer: str, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the ids and masks of `format_conversations`, whose row order it needs.

    `conv_col`, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256 (all text
    under the mask), formatted_chars (code points of the rendered conversation).
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    out = formatted.select(F.col(conv_col).alias("conv"), "place", "ids", "loss_mask").mapInArrow(
        _digests(tokenizer), f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.withColumnRenamed("conv", conv_col)
