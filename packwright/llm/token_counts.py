"""Edit-aware token counts: a segment tree of pre-token runs for each document.

Method. A text is cut before white space into leaves of some hundred characters, so every leaf but the first
begins with white space, and no pre-token crosses two leaves. A complete binary tree holds the characters and
the tokens of each run of leaves. An edit finds the leaves it touches by descending on the characters; these and
one leaf on either side, the boundary context that a lost or added space can reach, are encoded again, and the
sums above them are updated. All other leaves keep their counts.

Scale. Trees are built and edited where the documents are: one narrow pass each, no shuffle. A tree has some
two numbers per hundred characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import slices, text_or_empty, with_columns
from packwright.llm.word_tokens import WordIds, word_ids

#: Characters from which a leaf ends at the next white space.
LEAF = 128
_GAP = re.compile(r"[\x20\x09-\x0D]")

EDITS = "array<struct<start: int, end: int, text: string>>"


def leaves_of(text: str, leaf: int = LEAF) -> list[str]:
    out, start = [], 0
    while start < len(text):
        gap = _GAP.search(text, start + leaf)
        stop = gap.start() if gap else len(text)
        out.append(text[start:stop])
        start = stop
    return out or [""]


class TokenTree:
    """Characters and tokens of leaves, in heap order: node k has children 2k and 2k + 1, the root is 1."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums  # shape (nodes, 2)
        self.slots = len(sums) // 2

    @classmethod
    def build(cls, leaves: list[str], ids: WordIds) -> TokenTree:
        slots = 1 << (len(leaves) - 1).bit_length()
        tree = cls(np.zeros((2 * slots, 2), np.int64))
        for i, leaf in enumerate(leaves):
            tree.sums[slots + i] = len(leaf), count(leaf, ids)
        for k in range(slots - 1, 0, -1):
            tree.sums[k] = tree.sums[2 * k] + tree.sums[2 * k + 1]
        return tree

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character `at` (the last one with characters, at the end) and where it begins."""
        at = min(at, max(0, int(self.sums[1, 0]) - 1))
        k, before = 1, 0
        while k < self.slots:
            k *= 2
            if at - before >= self.sums[k, 0]:
                before += int(self.sums[k, 0])
                k += 1
        return k - self.slots, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.slots + leaf
        change = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2

    def edit(self, text: str, start: int, end: int, new: str, ids: WordIds) -> tuple[str, int]:
        """The text after the edit, and how many of its characters were encoded again."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        _, first = self.find(start)
        low, first = self.find(max(0, first - 1))
        high, last = self.find(max(start, end - 1))
        stop = last + int(self.sums[self.slots + high, 0])
        if stop < len(text):
            high, last = self.find(stop)
            stop = last + int(self.sums[self.slots + high, 0])
        region = text[first:start] + new + text[end:stop]
        parts = leaves_of(region)
        room = high - low + 1
        parts[room - 1 :] = ["".join(parts[room - 1 :])] if len(parts) > room else parts[room - 1 :]
        for i in range(room):
            part = parts[i] if i < len(parts) else ""
            self.put(low + i, len(part), count(part, ids))
        return text[:start] + new + text[end:], len(region)


def count(text: str, ids: WordIds) -> int:
    return len(ids.encode(text.encode())) >> 2


def _trees(batch: pa.RecordBatch, ids: WordIds) -> list[TokenTree]:
    return [TokenTree.build(leaves_of(t), ids) for t in batch.column("text").to_pylist()]


def _edited(batch: pa.RecordBatch, trees: list[TokenTree], ids: WordIds, keep_text: bool) -> dict[str, pa.Array]:
    """Columns after the edits of a batch; the trees are changed."""
    texts, again, before = [], [], [t.tokens for t in trees]
    for text, tree, todo in zip(batch.column("text").to_pylist(), trees, batch.column("edits").to_pylist(), strict=True):
        n = 0
        for e in todo or []:
            if e is not None:
                text, m = tree.edit(text, e["start"] or 0, e["end"] or 0, e["text"] or "", ids)
                n += m
        texts.append(text)
        again.append(n)
    more = {"tokens_before": pa.array(before, pa.int64()), "n_tokens": pa.array([t.tokens for t in trees], pa.int64()),
            "edited_chars": pa.array([len(t) for t in texts], pa.int64()), "encoded_again": pa.array(again, pa.int64())}
    if keep_text:
        more |= {"text": pa.array(texts, pa.string()),
                 "tree": pa.array([t.sums.ravel() for t in trees], pa.list_(pa.int64()))}
    return more


def _edited_schema(row: str, keep_text: bool) -> str:
    more = ", text string, tree array<long>" if keep_text else ""
    return f"row {row}, tokens_before long, n_tokens long, edited_chars long, encoded_again long{more}"


def build_trees(docs: DataFrame, text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """All columns of the documents as struct `row`, with text (null as empty), n_tokens and tree (characters
    and tokens of each node in heap order)."""
    packed = docs.select(F.struct("*").alias("row"), text_or_empty(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for batch in slices(batches, "text"):
            trees = _trees(batch, ids)
            yield with_columns(batch, {
                "n_tokens": pa.array([t.tokens for t in trees], pa.int64()),
                "tree": pa.array([t.sums.ravel() for t in trees], pa.list_(pa.int64())),
            })

    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {row}, text string, n_tokens long, tree array<long>")


def apply_edits(trees: DataFrame, edits: Column, vocabulary: str | None = None, keep_text: bool = True) -> DataFrame:
    """Trees after their edits: as build_trees gives them, with tokens_before, edited_chars (of the text after
    all edits) and encoded_again (characters).

    `edits` is an array of (start, end, text) in code points, applied one after the other, each to the text that
    the one before left. Defined cases: positions outside the text are moved to its ends, an end before its
    start counts as the start; a null edit, or null array, changes nothing; null positions are 0, a null text
    is empty; empty texts have one empty leaf.
    """
    asked = trees.withColumn("edits", edits.cast(EDITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for batch in slices(batches, "text"):
            own = [TokenTree(t.values.to_numpy().reshape(-1, 2).copy()) for t in batch.column("tree")]
            yield with_columns(batch.select(["row"]), _edited(batch, own, ids, keep_text))

    row = trees.schema["row"].dataType.simpleString()
    return asked.select("row", "text", "tree", "edits").mapInArrow(run, _edited_schema(row, keep_text))


def build_and_edit(
    docs: DataFrame, edits: Column, id_column: str | None = None, text_column: str = "text",
    vocabulary: str | None = None, keep_text: bool = True,
) -> DataFrame:
    """`apply_edits` of `build_trees` in one pass, for edits that are known when the trees are built: a worker
    then learns each word once for both. `edits` is an expression on the documents; `row` holds all their
    columns, or the id alone if it is named. Defined cases as in `apply_edits`."""
    row = F.struct("*") if id_column is None else F.struct(F.col(id_column))
    packed = docs.select(row.alias("row"), text_or_empty(text_column).alias("text"), edits.cast(EDITS).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for batch in slices(batches, "text"):
            yield with_columns(batch.select(["row"]), _edited(batch, _trees(batch, ids), ids, keep_text))

    return packed.mapInArrow(run, _edited_schema(packed.schema["row"].dataType.simpleString(), keep_text))
