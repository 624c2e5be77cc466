"""Ranked lexical search: the best documents of each item, by branch and bound over FP-trees.

Method. Of each document only the terms that some item asks for are kept, with their frequency in it (`tf`). Terms
are ordered by how many documents hold them, most frequent first, so that documents share the beginnings of their
vectors: sorted, they form a trie, whose paths without branches are one node. A node knows, for every term below
it, the largest tf, and the smallest length norm `m`. As a term's part of the score grows with tf and falls with
m, these give a bound that no document below exceeds; at a document they give its score. Each item is searched
depth first, the child with the best bound first, and a child whose bound is less than the item's k-th score so
far is left out. So nothing is lost: ties are looked at.

Scale. Documents are read once for their vectors, which are written. A tree holds TREE_ENTRIES terms and tfs, so
its size does not follow from the data; a task takes one tree after the other, keeps the k best of each item, and
what it learned bounds the next tree. Only those k per task and item are shuffled, and cut again in spread-out
groups. Items are taken in blocks of at most BLOCK_BYTES (or one item): their terms are all that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.llm.common import slices, text_or_empty, texts_of, written

#: Results of an item.
TOP = 10
#: Percent of the length norm that follows the document's length, and what scores are scaled by (fixed values).
LENGTH_PERCENT, SCALE = 90, 1_000_000_000
#: Terms of documents in a tree, and documents a node without children may have.
TREE_ENTRIES = 1_000_000
LEAF_DOCS = 32
#: Bytes of item texts whose terms are sent to every task.
BLOCK_BYTES = 8 << 20
#: Groups in which an item's results of all tasks are cut before they meet.
GROUPS = 64

#: Letters, digits and every byte of a character beyond ASCII stay; only A-Z are lowered.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _item_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items' ids and distinct terms, block by block."""
    texts = written(items.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).distinct(), "items")
    size = F.sum(F.octet_length("text"))
    total = texts.agg(size.alias("b")).first().b or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    block = F.xxhash64("id", "text")
    while blocks > 1:
        sizes = texts.groupBy(F.pmod(block, F.lit(blocks))).agg(size.alias("b"), F.count("*").alias("n"))
        if sizes.where(f"b > {2 * BLOCK_BYTES} and n > 1").isEmpty():
            break
        blocks *= 2
    for i in range(blocks):
        rows = texts.where(F.pmod(block, F.lit(blocks)) == i).collect()
        if rows:
            yield [(r.id, sorted(set(terms(r.text.encode())))) for r in rows]


def _vectors(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of documents with a term: how many terms they have, and those of the index as numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "text"):
            row, lengths, numbers, tfs = [], [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                found = terms(text)
                if found:
                    which, tf = np.unique(np.array([known[t] for t in found if t in known], np.int32), return_counts=True)
                    row.append(i)
                    lengths.append(len(found))
                    numbers.append(which.tobytes())
                    tfs.append(tf.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(lengths, pa.int64()), pa.array(numbers, pa.binary()), pa.array(tfs, pa.binary())],
                names=["id", "n", "terms", "tfs"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, terms binary, tfs binary")


def _document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the index occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_terms


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score, for each unit of its weight."""
    return (SCALE * tf) // (1000 * tf + 8 * m)


class Node:
    """A node's children side by side: for each the terms below it and what they can add at most. A leaf's children
    are documents, `first` being the place of its first one in the tree's order."""

    __slots__ = ("children", "ends", "first", "terms", "parts")

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], children: list[Node] | None, first: int):
        self.children, self.first = children, first
        sizes = [len(t) for t, _, _ in rows]
        self.ends = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.terms = np.concatenate([t for t, _, _ in rows])
        tf = np.concatenate([f for _, f, _ in rows])
        self.parts = parts(tf, np.repeat(np.array([m for _, _, m in rows], np.int64), sizes))

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.terms] * self.parts, self.ends)


def _maxima(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest tf of each term, and the smallest m."""
    which, tf = np.concatenate([t for t, _, _ in rows]), np.concatenate([f for _, f, _ in rows])
    order = np.argsort(which, kind="stable")
    which, tf = which[order], tf[order]
    new = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    return which[new], np.maximum.reduceat(tf, new), min(m for _, _, m in rows)


def tree(vectors: list[tuple[np.ndarray, np.ndarray, int]], place: np.ndarray) -> tuple[Node, list[int]]:
    """The trie of some vectors (terms, tfs, m), none of them empty, and the order of the vectors in it.

    `place` is each term's rank by frequency. In the order of their paths, the documents below a node stand side
    by side, and two neighbours part at the node whose depth is the length of their common beginning.
    """
    paths = [np.sort(place[t]).astype(">u4").tobytes() for t, _, _ in vectors]
    order = sorted(range(len(paths)), key=paths.__getitem__)
    common = [0] * (len(order) + 1)
    for i in range(1, len(order)):
        a, b = paths[order[i - 1]], paths[order[i]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(np.frombuffer(a, np.uint32, n >> 2) != np.frombuffer(b, np.uint32, n >> 2))
        common[i] = int(differ[0]) if len(differ) else n >> 2
    rows = [vectors[i] for i in order]

    # A stretch of documents that part at one depth closes when a shallower one follows: children come first.
    stack: list[list] = [[0, 0, []]]  # depth, first document, closed children as (first, last)
    ranges: list[tuple[int, int, list]] = []

    def close(top: list, last: int) -> tuple[int, int, list]:
        done = (top[1], last, top[2])
        ranges.append(done)
        return done

    for i in range(1, len(order) + 1):
        depth = common[i] if i < len(order) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            done = close(top, i)
            first = top[1]
            if stack and stack[-1][0] >= depth:
                stack[-1][2].append(done)
            elif depth >= 0:
                stack.append([depth, first, [done]])
        if depth >= 0 and stack[-1][0] < depth:
            stack.append([depth, first, []])

    return _node(ranges[-1], rows), order


def _node(top: tuple[int, int, list], rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Node:
    """Nodes of a range and all below it, children before parents, without recursion: a trie may be deep."""
    built: dict[int, tuple[Node, tuple]] = {}
    todo = [(top, False)]
    while todo:
        one, ready = todo.pop()
        first, last, inner = one
        if last - first <= LEAF_DOCS or not inner:
            built[id(one)] = _grouped(rows, first, last)
            continue
        if not ready:
            todo.append((one, True))
            todo += [(child, False) for child in inner]
            continue
        children, at = [], first
        for child in inner:
            if child[0] > at:  # documents that branch off here by themselves
                children.append(_grouped(rows, at, child[0]))
            children.append(built.pop(id(child)))
            at = child[1]
        if at < last:
            children.append(_grouped(rows, at, last))
        if len(children) == 1:
            built[id(one)] = children[0]
        else:
            summary = [s for _, s in children]
            built[id(one)] = (Node(summary, [n for n, _ in children], first), _maxima(summary))
    return built[id(top)][0]


def _grouped(rows: list, first: int, last: int) -> tuple[Node, tuple]:
    """A node over documents; many of them lie below it in leaves of LEAF_DOCS."""
    leaves = [
        (Node(rows[i : min(i + LEAF_DOCS, last)], None, i), _maxima(rows[i : min(i + LEAF_DOCS, last)]))
        for i in range(first, last, LEAF_DOCS)
    ]
    if len(leaves) == 1:
        return leaves[0]
    summary = [s for _, s in leaves]
    return Node(summary, [n for n, _ in leaves], first), _maxima(summary)


def search(top: Node, weights: np.ndarray, ids: list, best: list[tuple], k: int) -> list[tuple]:
    """The k best (-score, id is null, id) of the tree's documents and of those already found."""
    todo = [(top, 1)]
    while todo:
        node, bound = todo.pop()
        least = -best[-1][0] if len(best) == k else 1
        if bound < least and node is not top:
            continue
        bounds = node.bounds(weights)
        good = np.flatnonzero(bounds >= least)
        if not len(good):
            continue
        if node.children is None:
            found = [(-int(bounds[i]), ids[node.first + i] is None, ids[node.first + i]) for i in good.tolist()]
            best = sorted(best + found, key=_order)[:k]
        else:
            for i in good[np.argsort(bounds[good], kind="stable")].tolist():
                todo.append((node.children[i], int(bounds[i])))
    return best


def _order(found: tuple) -> tuple:
    return (found[0], found[1]) if found[1] else found


def _ranked(vectors: DataFrame, items: list[list[int]], weights: np.ndarray, place: np.ndarray, n_docs: int, n_terms: int, k: int, tree_entries: int) -> DataFrame:
    """(item, id, score): the k best documents of each task for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, place))
    kind = vectors.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, place = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        held, ids, entries, type_ = [], [], 0, None

        def searched() -> None:
            root, order = tree(held, place)
            there = [ids[i] for i in order]
            mine = np.zeros(len(weights), np.int64)
            for i, wanted in enumerate(items):
                mine[wanted] = weights[wanted]
                best[i] = search(root, mine, there, best[i], k)
                mine[wanted] = 0

        for batch in batches:
            type_ = batch.column("id").type
            for id_, n, numbers, tfs in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "terms", "tfs")), strict=True):
                if numbers:
                    held.append((np.frombuffer(numbers, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64), norm(n, n_docs, n_terms)))
                    ids.append(id_)
                    entries += len(numbers) >> 2
                    if entries >= tree_entries:
                        searched()
                        held, ids, entries = [], [], 0
        if held:
            searched()
        rows = [(i, id_, -score) for i, found in enumerate(best) for score, _, id_ in found]
        if rows:
            item, id_, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(id_, type_), pa.array(score, pa.int64())], names=["item", "id", "score"]
            )

    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    return vectors.mapInArrow(run, schema)


def rank_documents(
    items: DataFrame,
    docs: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    k: int = TOP,
    tree_entries: int = TREE_ENTRIES,
) -> DataFrame:
    """(item id, rank, document id, score): each item's k best documents with a score above 0, best first.

    Ties go to the smaller document id, a null one last. Defined cases: a null or empty text has no term: such a
    document is not counted, such an item has no result; repeated documents are ranked each; an item given twice
    with equal id and text counts once, with another text it is a search of its own under that id; extra columns
    play no part; an empty table gives no row.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text"))
    out = None
    for block in _item_blocks(items, item_id, item_text):
        ranked = _block(spark, texts, block, items.schema[item_id].dataType, k, tree_entries)
        out = ranked if out is None else out.union(ranked)
    if out is None:
        kinds = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
        out = spark.createDataFrame([], f"item_key {kinds[0]}, rank int, id {kinds[1]}, score long")
    return out.select(F.col("item_key").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def _block(spark: SparkSession, texts: DataFrame, block: list[tuple[object, list[bytes]]], kind: T.DataType, k: int, tree_entries: int) -> DataFrame:
    vocabulary = sorted({t for _, found in block for t in found})
    index = {t: i for i, t in enumerate(vocabulary)}
    vectors = written(_vectors(texts, index), "vectors")
    facts = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = _document_counts(vectors, len(vocabulary))
    weights = np.array([weight(facts.docs, int(n)) for n in df], np.int64)
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    # A term no document has adds nothing.
    asked = [[index[t] for t in found if df[index[t]]] for _, found in block]
    ranked = _ranked(vectors, asked, weights, place, facts.docs, facts.terms or 0, k, tree_entries)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    group = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(GROUPS))
    few = ranked.withColumn("_g", group).withColumn("_r", F.row_number().over(Window.partitionBy("item", "_g").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    top = few.where(F.col("_r") <= k).drop("_g", "_r").withColumn("rank", rank).where(F.col("rank") <= k)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_key", kind)])
    keys = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(block)], schema)
    return top.join(F.broadcast(keys), "item").select("item_key", "rank", "id", "score")


def rank_sql(items: str = "benchmark", docs: str = "documents", k: int = TOP) -> str:
    """The same in DuckDB."""
    found = (
        "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
        WITH docs AS (SELECT doc_id, {found.format("text")} AS t FROM {docs} WHERE text IS NOT NULL),
            sizes AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0),
            facts AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
            tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY ALL),
            weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
                FROM (SELECT term, count(*) AS df FROM tfs GROUP BY 1), facts),
            norms AS (SELECT doc_id, {100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * nd) // l AS m FROM sizes, facts),
            asked AS (SELECT DISTINCT item_id, unnest({found.format("text")}) AS term FROM {items} WHERE text IS NOT NULL),
            scores AS (SELECT item_id, doc_id, CAST(sum(w * (({SCALE} * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
                FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
            ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                doc_id, score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= {k}"""
