"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian pruning, exact confirmation.

Method. Documents with the same word sequence are one class. A class has a MinHash signature; classes that
agree on all hashes of a band share a bucket. Candidate pairs compare their signatures batch by batch: with m
of n hashes equal and a uniform prior, the similarity's posterior is Beta(m + 1, n - m + 1), and the pair goes
as soon as P(similarity >= threshold) falls under the chosen miss probability. Survivors are compared on
their full shingle sets; only these are links.

Scale. A bucket's pairs are never all written out. First every member meets its bucket's smallest and largest
class, which is linear. Of the pairs that survive, each class first confirms the one that agrees best, then only
pairs that could still join two components are confirmed. Only buckets that still hold several
components go on: their members are cut into blocks, two blocks meet in one call of numpy, and pairs inside
one component are skipped. Blocks carry the full sets, so survivors are confirmed where they meet and only links
that join two components leave a task. So no link between components is lost, and no pair is a row.

Texts travel seldom: a Bloom filter of bounded size keeps those of unwanted classes where they are, each task
sends one text of a class, and a hub's text goes once to each group of its partners. Rows whose class is alone
get their answer where they are; classes and components that hold a share of all rows are broadcast, as there
are few of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import (
    WordHashes, mixed, slices, texts_of, window_hashes, with_columns, written,
)
from packwright.llm.components import components
from packwright.llm.url_filter import possible
from packwright.session import settings

#: 32 bands of 4 hashes: a pair at 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared before each look at the posterior.
BATCH = 16
#: A pair is dropped once its chance of reaching the threshold is below this.
MISS = 1e-6
#: Members of a block, and members of one component in one bucket from which they get blocks of their own.
BLOCK, LARGE = 256, 64
#: Shingles of a block on average, so that long texts make small blocks (8 MB); one longer text has its own.
BLOCK_SHINGLES = 1 << 20
#: A key with more than one row in HEAVY is joined by broadcast: there are fewer than HEAVY such keys.
HEAVY = 1000
#: Partners of a hub that are confirmed together.
PARTNERS = 512

_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than `size` make one shingle, none makes none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(window_hashes(h, min(size, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Top 16 bits of the smallest multiplied hash, for each of the multipliers."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024, None] * _MULTIPLIERS
        np.minimum(low, part.min(axis=0), out=low)
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


def least_agreement(threshold: float, miss: float) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ... compared hashes: the fewest equal ones with which a pair stays.

    P(s >= t | m of n) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return tuple(out)


def may_link(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for k, fewest in enumerate(least):
        at = slice(k * BATCH, (k + 1) * BATCH)
        equal[alive] += (a[alive, at] == b[alive, at]).sum(axis=1, dtype=np.int32)
        alive = alive[equal[alive] >= fewest]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def with_classes(docs: DataFrame, text: str, size: int, counted: bool = True, signed: bool = True) -> DataFrame:
    """Documents with `_class` (16 bytes that stand for the lower-cased word sequence), if counted with
    `_n` (distinct shingles) and if signed with `_sig`. One narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, text, 4 << 20):
            classes, counts, sigs = [], [], []
            for value in texts_of(batch.column(text)):
                words = value.lower().split()
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if counted or signed:
                    shingles = shingle_set(words, size, hashes)
                    counts.append(len(shingles))
                if signed:
                    sigs.append(signature(shingles).tobytes() if len(shingles) else None)
            more = {"_class": pa.array(classes, pa.binary())}
            if counted:
                more["_n"] = pa.array(counts, pa.int64())
            if signed:
                more["_sig"] = pa.array(sigs, pa.binary())
            yield with_columns(batch, more)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = "_class binary" + ", _n long" * counted + ", _sig binary" * signed
    return docs.mapInArrow(run, f"{fields}, {more}")


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: Column) -> DataFrame:
    """Inner join on a key that is unique on the right. Keys marked heavy are broadcast (the caller knows that they
    are few), so that none of them gathers its rows in one task."""
    hot = F.broadcast(right.where(heavy))
    light = left.join(F.broadcast(right.where(heavy).select(key)), key, "left_anti").join(right.where(~heavy), key)
    return left.join(hot, key).unionByName(light)


def _texts(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(_class, t): the text of one document of each wanted class (`_class`, distinct)."""
    texts = with_classes(docs.select(F.col(text).cast("string").alias("t")), "t", 0, counted=False, signed=False)

    wanted = possible(texts, "_class", nodes).where("possible").select("_class", "t")
    # Each task keeps one text of a class before anything is sent.
    once = wanted.groupBy("_class").agg(F.first("t").alias("t"))
    return written(once.join(nodes, "_class", "left_semi"), "texts")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles): sorted distinct shingle hashes of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "t", 4 << 20):
            sets = [np.sort(shingle_set(v.lower().split(), size, hashes).view(np.int64)) for v in texts_of(batch.column("t"))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets or [np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_class"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "shingles"]
            )

    return texts.mapInArrow(run, "node binary, shingles array<long>")


def exact_links(pairs: DataFrame, docs: DataFrame, text: str, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes whose full shingle sets reach the threshold, of the distinct pairs (hub, node).

    Texts come from one document of each class. A hub's text goes before those of its partners, once for each
    PARTNERS of them.
    """
    pairs = written(pairs.select("hub", "node"), "asked")
    texts = _texts(pairs.select(F.explode(F.array("hub", "node")).alias("_class")).distinct(), docs, text)
    many = pairs.groupBy("hub").count().where(F.col("count") > PARTNERS)
    group = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / PARTNERS)), F.lit(0))
    grouped = pairs.join(many, "hub", "left").select("hub", "node", group.alias("part"))
    partners = grouped.join(texts.withColumnRenamed("_class", "node"), "node")
    hubs = grouped.select("hub", "part").distinct().join(texts.withColumnRenamed("_class", "hub"), "hub")
    first = hubs.select("hub", "part", F.lit(None).cast("binary").alias("node"), "t")
    sent = first.unionByName(partners).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node").asc_nulls_first())
    # Whole-number arithmetic, so that a similarity of just the threshold is never lost to rounding.
    percent = round(threshold * 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = np.empty(0, np.uint64)
        for whole in batches:
            for batch in slices([whole], "t"):
                linked = []
                for node, value in zip(batch.column("node").to_pylist(), texts_of(batch.column("t")), strict=True):
                    shingles = shingle_set(value.lower().split(), size, hashes)
                    if node is None:
                        own = shingles
                        linked.append(False)
                        continue
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    union = len(own) + len(shingles) - both
                    linked.append(10_000 * both >= percent * union)
                yield batch.select(["hub", "node"]).filter(pa.array(linked, pa.bool_()))

    found = sent.mapInArrow(run, "hub binary, node binary")
    return found.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))


def _star_links(pairs: DataFrame, docs: DataFrame, text: str, size: int, threshold: float) -> DataFrame:
    """Components (node, comp) of the links among the pairs (a, b, agree). Each class confirms its best pair first;
    of the others, only those whose classes are still apart."""
    ends = pairs.select("a", "b", "agree").union(pairs.select(F.col("b"), F.col("a"), "agree")).toDF("node", "hub", "agree")
    best = ends.groupBy("node").agg(F.max(F.struct("agree", "hub")).alias("m")).select("node", "m.hub")
    # A pair that is best for both is confirmed once.
    best = written(
        best.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .agg(F.max(F.struct("hub", "node")).alias("p")).select("a", "b", "p.*"),
        "best",
    )
    labels = components(exact_links(best, docs, text, size, threshold), written)
    rest = pairs.join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        at = labels.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}"))
        rest = rest.join(at, end, "left")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    rest = written(rest.where(apart).select(F.col("a").alias("hub"), F.col("b").alias("node")), "apart")
    if rest.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return components(exact_links(rest, docs, text, size, threshold).union(known), written)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
    miss: float = MISS,
) -> DataFrame:
    """All columns of the documents as struct `row`, with n_shingles, component_id and kept.

    component_id is the smallest id that links lead to. Defined cases: a null text, or one without a word,
    has no shingle, links with nothing and is its own component. Repeated rows stay rows, each with the same
    answer. A null id is never a smallest id; a component in which all ids are null has a null component_id,
    and kept is then true. Extra columns of any name travel inside `row`. An empty table gives no row.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    _, answers = _judged(rows, shingle_words, threshold, miss)
    # The text goes to Python once, beside the other columns; `row` is put together again behind it.
    once = docs.schema[text_column].dataType.simpleString() == "string" and len({*map(str.lower, docs.columns)}) == len(docs.columns) > 1
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_column] if once else ["*"]
    packed = docs.select(
        F.struct(*others).alias("row"), F.col(id_column).alias("_id"),
        F.col(text_column).cast("string").alias("_text"),
    )
    whole = F.struct(*[(F.col("_text") if c == text_column else F.col("row").getField(c)).alias(c) for c in docs.columns])
    made = lambda rows: (rows.withColumn("row", whole) if once else rows).drop("_text")
    counted = made(with_classes(packed, "_text", shingle_words, signed=False))
    keyed = made(with_classes(packed, "_text", shingle_words, counted=False, signed=False))
    return _with_answers(counted, keyed, answers).drop("_id")


def _judged(rows: DataFrame, shingle_words: int, threshold: float, miss: float) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _class, _n) of the rows (_id, _text), and the answers for their classes."""
    signed = written(with_classes(rows, "_text", shingle_words).drop("_text"), "signed")
    classes = written(
        signed.where("_n > 0").groupBy("_class").agg(
            F.min("_id").alias("id"), F.first("_n").alias("n"), F.first("_sig").alias("sig"), F.count("*").alias("copies")
        ).withColumnRenamed("_class", "node"),
        "classes",
    )
    members = _members(classes)
    # Most classes share no bucket; their signatures need not travel.
    shared = members.select("node").distinct()
    signatures = written(possible(classes, "node", shared).where("possible").select("node", "n", "sig"), "signatures")
    labels = _star_links(_star_pairs(members, signatures, threshold, miss), rows, "_text", shingle_words, threshold)
    more = _rest_links(members, signatures, labels, rows, shingle_words, threshold, miss)
    if not more.isEmpty():
        known = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        labels = components(more.union(known), written)
    return signed.drop("_sig"), _answers(classes, labels)


def near_duplicate_ids(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = 5,
    threshold: float = 0.8,
    miss: float = MISS,
) -> DataFrame:
    """As near_duplicates, but with the id alone instead of `row`: no text is read a second time for rows."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    signed, answers = _judged(rows, shingle_words, threshold, miss)
    return _with_answers(signed, signed.drop("_n"), answers).withColumnRenamed("_id", id_column)


def _members(classes: DataFrame) -> DataFrame:
    """(node, band, bucket) of buckets with several classes; a bucket's low bits are its band."""
    hashed = lambda i: F.xxhash64(F.substring("sig", i * ROWS * 2 + 1, ROWS * 2))
    bucket = lambda i: hashed(i).bitwiseAND(F.lit(-BANDS)).bitwiseOR(F.lit(i))
    banded = classes.select("node", F.explode(F.array(*[bucket(i) for i in range(BANDS)])).alias("bucket"))
    shared = banded.groupBy("bucket").count().where("count > 1").select("bucket")
    found = banded.join(shared, "bucket", "left_semi")
    return written(found.withColumn("band", F.col("bucket").bitwiseAND(F.lit(BANDS - 1)).cast("int")), "members")


def _signed_pairs(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs that survive the sizes and the sequential test."""
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    t, least = round(threshold * 10_000), least_agreement(threshold, miss)
    joined = pairs.join(a, "a").join(b, "b").where(
        F.least("na", "nb") * 10_000 >= F.greatest("na", "nb") * t
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (_signatures(batch.column(c).to_pylist()) for c in ("sa", "sb"))
                agree = pa.array((sa == sb).sum(axis=1).astype(np.int32))
                yield with_columns(batch.select(["a", "b"]), {"agree": agree}).filter(pa.array(may_link(sa, sb, least)))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, agree int")


def _signatures(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), HASHES)


def _star_pairs(members: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Every member with the smallest and the largest class of its bucket."""
    hubs = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    met = members.join(hubs, "bucket")
    pairs = met.select(F.col("low").alias("a"), F.col("node").alias("b")).union(
        met.select(F.col("node").alias("a"), F.col("high").alias("b"))
    )
    pairs = pairs.where("a < b").distinct()
    return written(_signed_pairs(pairs, classes, threshold, miss), "pairs")


def _rest_links(
    members: DataFrame, classes: DataFrame, labels: DataFrame, rows: DataFrame, size: int, threshold: float, miss: float
) -> DataFrame:
    """Links between different components: every pair that survives the sequential test is confirmed, in its
    first common bucket, unless links found in the same task already join its components."""
    at = members.join(labels, "node", "left").select(
        "bucket", "band", "node", F.coalesce("comp", "node").alias("comp")
    )
    parts = lambda count, shingles: F.ceil(F.greatest(F.col(count) / BLOCK, F.col(shingles) / BLOCK_SHINGLES))
    open_ = at.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    open_at = at.join(open_.select("bucket"), "bucket", "left_semi")
    at = written(open_at.join(classes.select("node", "n"), "node"), "open")
    sizes = at.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    small = sizes.where(F.col("c") < LARGE).groupBy("bucket").agg(F.sum("c").alias("all_c"), F.sum("s").alias("all_s"))
    # A large component has blocks of its own; the members of small ones share blocks, whole components each.
    placed = at.join(sizes, ["bucket", "comp"]).join(small, "bucket", "left").select(
        "bucket", "band", "node", "comp", "n",
        F.when(F.col("c") >= LARGE, F.col("comp")).alias("own"),
        F.when(
            F.col("c") >= LARGE, F.pmod(F.xxhash64("node"), parts("c", "s"))
        ).otherwise(F.pmod(F.xxhash64("comp"), parts("all_c", "all_s"))).alias("part"),
    )
    signed = placed.join(classes.select("node", "sig"), "node")
    t, least = round(threshold * 10_000), least_agreement(threshold, miss)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, bucket, x, y in zip(*(batch.column(c) for c in ("band", "bucket", "left", "right")), strict=True):
                i, j = _survivors(band.as_py(), x.values, y.values, t, least)
                found = [x.values.field("node").take(pa.array(np.unique(i))), y.values.field("node").take(pa.array(np.unique(j)))]
                nodes = pa.concat_arrays(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket.as_py()] * len(nodes), pa.int64()), nodes], names=["bucket", "node"]
                )

    # Full sets go only to the buckets that see to a pair of theirs. Pairs of blocks are large, so few travel
    # together.
    met = _met(signed, ["node", "comp", "n", "sig"])
    with settings(members.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
        needed = written(met.mapInArrow(active, "bucket long, node binary").distinct(), "active")
    sets = _sets(_texts(needed.select(F.col("node").alias("_class")).distinct(), rows, "_text"), size)
    full = signed.join(needed, ["bucket", "node"], "left_semi").join(sets, "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, x, y in zip(*(batch.column(c) for c in ("band", "left", "right")), strict=True):
                links = _meet(band.as_py(), x.values, y.values, t, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in links], pa.binary()) for k in (0, 1)], names=["a", "b"]
                )

    with settings(members.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):
        return written(
            _met(full, ["node", "comp", "n", "sig", "shingles"]).mapInArrow(confirm, "a binary, b binary"), "rest"
        )


def _met(signed: DataFrame, columns: list[str]) -> DataFrame:
    """(band, bucket, left, right): blocks of one bucket, each pair once, but for two of one large component."""
    blocks = signed.groupBy("bucket", "own", "part").agg(
        F.min("band").alias("band"), F.collect_list(F.struct(*columns)).alias("members")
    ).withColumn("block", F.struct(F.coalesce("own", F.lit(b"")).alias("own"), "part"))
    left = blocks.select("bucket", "band", "own", F.col("block").alias("x"), F.col("members").alias("left"))
    right = blocks.select("bucket", F.col("own").alias("own2"), F.col("block").alias("y"), F.col("members").alias("right"))
    met = left.join(right, "bucket").where("x <= y and not coalesce(own = own2, false)")
    return met.select("band", "bucket", "left", "right")


def _survivors(band: int, xs: pa.Array, ys: pa.Array, t: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two blocks in different components that pass sizes and signatures and have this band as
    the first in which all hashes agree; those that agree best come first."""
    comps = [v.field("comp").to_pylist() for v in (xs, ys)]
    number = {c: i for i, c in enumerate(dict.fromkeys(comps[0] + comps[1]))}
    cx, cy = (np.array([number[c] for c in v]) for v in comps)
    n = [v.field("n").to_numpy() for v in (xs, ys)]
    i, j = np.nonzero(
        (cx[:, None] != cy[None, :])
        & (np.minimum(n[0][:, None], n[1]) * 10_000 >= np.maximum(n[0][:, None], n[1]) * t)
    )
    sx, sy = (_signatures(v.field("sig").to_pylist()) for v in (xs, ys))
    ok = may_link(sx[i], sy[j], least)
    i, j = i[ok], j[ok]
    same = sx[i] == sy[j]
    first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
    order = np.argsort(-same[first].sum(axis=1), kind="stable")
    return i[first][order], j[first][order]


def _meet(band: int, xs: pa.Array, ys: pa.Array, t: int, least: tuple[int, ...]) -> list[tuple[bytes, bytes]]:
    """Links that join components, for two blocks of members that share the bucket of a band."""
    i, j = _survivors(band, xs, ys, t, least)
    nodes, comps = ([v.field(c).to_pylist() for v in (xs, ys)] for c in ("node", "comp"))
    number = {c: i for i, c in enumerate(dict.fromkeys(comps[0] + comps[1]))}
    cx, cy = ([number[c] for c in v] for v in comps)
    sets = [[v.field("shingles")[k].values.to_numpy() for k in range(len(v))] if len(i) else [] for v in (xs, ys)]
    root, links = list(range(len(number))), []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        c, d = find(cx[p]), find(cy[q])
        if c != d:
            small, large = sorted((sets[0][p], sets[1][q]), key=len)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            if 10_000 * both >= t * (len(small) + len(large) - both):
                root[max(c, d)] = min(c, d)
                links.append(tuple(sorted((nodes[0][p], nodes[1][q]))))
    return links


def _answers(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(_class, n, component_id, copies, linked) for every class that has a shingle."""
    ids = classes.select("node", "id", "n", "copies")
    comp = written(ids.join(labels, "node"), "linked")
    total = comp.count()
    low = comp.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("classes"))
    linked = spread_join(comp, low, "comp", F.col("classes") * HEAVY > total)
    alone = ids.join(labels, "node", "left_anti").withColumn("component_id", F.col("id"))
    out = linked.withColumn("linked", F.lit(True)).unionByName(alone.withColumn("linked", F.lit(False)), allowMissingColumns=True)
    return written(out.select(F.col("node").alias("_class"), "n", "component_id", "copies", "linked"), "answers")


def _with_answers(counted: DataFrame, keyed: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with n_shingles, component_id and kept. `counted` and `keyed` are the same rows with `_class`, `counted`
    with `_n`, too.

    A class of one row without a link needs no join; a filter tells most of them. Classes that hold a share of all
    rows are broadcast. Only what is left is shuffled.
    """
    several = answers.where("linked or copies > 1")
    total = answers.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    heavy = F.broadcast(
        answers.where(F.col("copies") * HEAVY > total).select("_class", F.col("component_id").alias("heavy_id"))
    ).withColumn("heavy", F.lit(True))
    flagged = lambda rows: possible(rows, "_class", several.select("_class")).join(heavy, "_class", "left")
    here = flagged(counted).where("heavy or not possible").withColumns({
        "component_id": F.when(F.col("heavy"), F.col("heavy_id")).otherwise(F.col("_id")), "n": F.col("_n"),
    }).drop("_n")
    asked = flagged(keyed).where("possible and heavy is null").join(answers, "_class", "left").withColumn(
        "component_id", F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    ).select(here.columns)
    component = F.col("component_id")
    return here.unionByName(asked).select(
        *[c for c in keyed.columns if c != "_class"],
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        component,
        (component.isNull() | F.coalesce(F.col("_id") == component, F.lit(False))).alias("kept"),
    )
