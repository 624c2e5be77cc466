"""Repeated passages: a compacted de Bruijn graph over the token windows of the whole corpus.

Method. A window of WINDOW consecutive words is an edge of the graph, from its first to its last WINDOW - 1
words, so neighbouring windows of a source share a node. Only edges that occur at least twice matter:
    1. Every window has one minimizer: the smallest hash among its runs of `seed` words. Equal windows have
       equal minimizers, so the far fewer minimizers are counted first and those seen once go.
    2. In sources with repeated minimizers, the consecutive windows of one minimizer form a stretch. Stretches
       with equal words are summed up; a stretch that occurs twice has only repeated edges.
    3. For the others, single edges are counted against the distinct stretches of the same minimizer.
    4. Repeated edges join back to their sources; consecutive ones with the same number of occurrences form a
       path without branches, which compacts into one span (start, words) of the source. The coordinates are
       those of the source text, and every span is made of edges counted by 64-bit hashes under a 64-bit
       minimizer: 128 bits in all.

Scale. Texts that are equal letter for letter count as one source with its number of copies. Counts are summed
up before the shuffle, so a passage in a third of all documents is no hot group; nothing is ever collected
but the spans of one source, which its length bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import (
    WordHashes, slices, text_or_empty, texts_of, window_hashes, with_columns, written,
)

WINDOW = 35
SEED = 16


def minimizers(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window, the smallest hash of its runs of `seed` words."""
    low, width, want = window_hashes(h, seed), 1, window - seed + 1
    while width < want:
        step = min(width, want - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _seeds(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(key, h, n): each source's distinct minimizers and at how many places it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            keys, found, counts = batch.column("key").to_numpy(), [], []
            sizes = np.zeros(len(keys), np.int64)
            for i, value in enumerate(texts_of(batch.column("text"))):
                words = value.split()
                if len(words) < window:
                    continue
                h = hashes.of(words)
                u, runs = np.unique(minimizers(h, window, seed)), window_hashes(h, seed)
                # Every place with the hash counts, so that periodic text is seen to repeat itself.
                at = np.minimum(np.searchsorted(u, runs), len(u) - 1)
                n = np.bincount(at[u[at] == runs], minlength=len(u))
                sizes[i] = len(u)
                found.append(u)
                counts.append(n)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(keys, sizes)), _signed(np.concatenate(found)), pa.array(np.concatenate(counts))],
                    names=["key", "h", "n"],
                )

    return texts.mapInArrow(run, "key long, h long, n long")


def _stretches(sources: DataFrame, window: int, seed: int) -> DataFrame:
    """(key, start, h, c, copies, twice, edges): stretches whose minimizer is among the source's `repeated` ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            keys, copies, repeated = (batch.column(c) for c in ("key", "copies", "repeated"))
            out: list[list] = [[], [], [], [], []]
            edges, lengths, twice = [], [0], []
            for i, value in enumerate(texts_of(batch.column("text"))):
                words = value.split()
                if len(words) < window:
                    continue
                h = hashes.of(words)
                low, full = minimizers(h, window, seed), window_hashes(h, window)
                wanted = np.isin(low, repeated[i].values.to_numpy().view(np.uint64))
                # A stretch ends where the minimizer changes, and after as many windows as one place can serve.
                new = np.concatenate([[True], low[1:] != low[:-1]])
                starts = np.flatnonzero(new)
                at = np.arange(len(low)) - np.repeat(starts, np.diff(np.append(starts, len(low))))
                starts = np.flatnonzero(at % (window - seed + 1) == 0)
                ends = np.append(starts[1:], len(low))
                take = wanted[starts]
                for s, e in zip(starts[take].tolist(), ends[take].tolist(), strict=True):
                    part = full[s:e]
                    out[0].append(s)
                    out[1].append(int(low[s].view(np.int64)))
                    out[2].append(hash_of(part))
                    edges.append(part)
                    lengths.append(e - s)
                    twice.append(len(np.unique(part)) < e - s)
                n = int(take.sum())
                out[3] += [keys[i].as_py()] * n
                out[4] += [copies[i].as_py()] * n
            if edges:
                offsets = pa.array(np.cumsum(lengths).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[3], pa.binary()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.int64()), pa.array(out[4], pa.int64()), pa.array(twice, pa.bool_()),
                        pa.ListArray.from_arrays(offsets, _signed(np.concatenate(edges))),
                    ],
                    names=["key", "start", "h", "c", "copies", "twice", "edges"],
                )

    return sources.mapInArrow(run, "key binary, start int, h long, c long, copies long, twice boolean, edges array<long>")


def hash_of(part: np.ndarray) -> int:
    """One number for a run of edges, its length included."""
    digest = hashlib.blake2b(part.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def repeated_paths(
    docs: DataFrame, text_column: str = "text", window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """(key, start, edges, occurrences): for every source text the nonbranching paths of repeated windows.

    `key` is the MD5 of the text, `start` the place of the path's first word, `edges` how many windows it has
    (it covers edges + window - 1 words), `occurrences` how often each of them starts in the corpus.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed must have between one word and as many as the window")
    texts = docs.select(text_or_empty(text_column).alias("text"))
    # The short key only picks sources for a second look, where a clash of two keys costs time, not truth.
    seeds = _seeds(texts.withColumn("key", F.xxhash64("text")), window, seed)
    often = seeds.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    short = written(
        seeds.join(often, "h", "left_semi").select("key", "h").distinct()
        .groupBy("key").agg(F.collect_list("h").alias("repeated")),
        "seeds",
    ).withColumnRenamed("key", "short")
    sources = (
        texts.groupBy(F.xxhash64("text").alias("short"), F.unhex(F.md5("text")).alias("key"))
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        .join(short, "short")
    )
    stretches = written(_stretches(sources, window, seed), "stretches")
    by_words = written(
        stretches.groupBy("h", "c").agg(
            F.sum("copies").alias("n"), F.first("edges").alias("edges"), F.first("twice").alias("twice"),
        ),
        "distinct",
    )
    # Minimizers with several different stretches, or one that repeats itself: their single edges are counted.
    mixed_h = by_words.groupBy("h").agg(
        F.count("*").alias("kinds"), F.max("twice").alias("twice")
    ).where("kinds > 1 or twice").select("h")
    open_ = by_words.join(mixed_h, "h", "left_semi")
    edges = open_.select("h", "n", F.explode("edges").alias("e")).groupBy("h", "e").agg(F.sum("n").alias("n"))
    edges = edges.where("n > 1")
    counted = written(
        open_.select("h", "c", F.posexplode("edges").alias("i", "e")).join(edges, ["h", "e"])
        .groupBy("h", "c").agg(F.collect_list(F.struct("i", "n")).alias("hits")),
        "counted",
    )
    closed = by_words.join(mixed_h, "h", "left_anti").where("n > 1").select(
        "h", "c", F.transform(F.sequence(F.lit(0), F.size("edges") - 1), lambda i: F.struct(i.alias("i"), F.col("n").alias("n"))).alias("hits")
    )
    hits = counted.select("h", "c", F.col("hits").cast("array<struct<i:int,n:bigint>>").alias("hits")).union(closed)
    found = stretches.select("key", "start", "h", "c").join(hits, ["h", "c"])
    return found.groupBy("key").agg(
        F.collect_list(F.struct("start", "hits")).alias("found")
    ).mapInArrow(_compacted, "key binary, start int, edges int, occurrences long")


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive repeated edges of a source with equal counts, as one path each."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for key, found in zip(batch.column("key").to_pylist(), batch.column("found"), strict=True):
            values = found.values
            each = values.field("hits")
            start = np.repeat(values.field("start").to_numpy(), pa.compute.list_value_length(each).to_numpy())
            flat = each.flatten()
            at = start + flat.field("i").to_numpy()
            order = np.argsort(at)
            at, n = at[order], flat.field("n").to_numpy()[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(n) != 0)]))
            out[0] += [key] * len(new)
            out[1] += at[new].tolist()
            out[2] += np.diff(np.append(new, len(at))).tolist()
            out[3] += n[new].tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
            names=["key", "start", "edges", "occurrences"],
        )


def without_repeats(
    docs: DataFrame,
    text_column: str = "text",
    window: int = WINDOW,
    seed: int = SEED,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of the documents as struct `row`, with n_words, n_removed, kept_sha256 and, if wanted,
    kept_text: the words that no repeated window covers, joined by one space.

    A window counts as repeated if its words start at two places of the corpus, in one document or in several;
    windows are judged on the input. Defined cases: a null or empty text has no word; a text shorter than the
    window keeps all; repeated rows are copies of each other, so their passages go from each; ids play no
    part, so null ids change nothing; an empty table gives no row.
    """
    paths = written(repeated_paths(docs, text_column, window, seed), "paths")
    spans = paths.groupBy("key").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))
    packed = docs.select(F.struct("*").alias("row"), text_or_empty(text_column).alias("text"))
    if not keep_text:
        packed = packed.withColumn("row", F.col("row").dropFields(text_column)) if len(docs.columns) > 1 else packed
    joined = packed.withColumn("key", F.unhex(F.md5("text"))).join(spans, "key", "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, removed, digests, kept_texts = [], [], [], []
            for value, spans in zip(texts_of(batch.column("text")), batch.column("spans"), strict=True):
                words = value.split()
                n_words.append(len(words))
                if spans.is_valid:
                    covered = np.zeros(len(words) + 1, np.int64)
                    start = spans.values.field("start").to_numpy()
                    np.add.at(covered, start, 1)
                    np.add.at(covered, start + spans.values.field("edges").to_numpy() + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
                removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept)
            more = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if keep_text:
                more["kept_text"] = pa.array(kept_texts, pa.binary()).cast(pa.string())
            yield with_columns(batch.select(["row"]), more)

    row = joined.schema["row"].dataType.simpleString()
    more = ", kept_text string" if keep_text else ""
    return joined.mapInArrow(run, f"row {row}, n_words long, n_removed long, kept_sha256 string{more}")
