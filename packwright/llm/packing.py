"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Method. A sequence is filled greedily with the largest pieces that still fit. Then its smallest piece is
replaced by two unpacked ones if those fit the expanded gap (the gap plus that piece) more tightly: the pair
with the largest sum is taken.

Scale. How a sequence is filled depends only on how many pieces of each length are left, and there are no more
lengths than the capacity. So the plan is made from that histogram (at most `capacity` numbers, whatever the
data): a filling is found once and used as often as the counts allow. Pieces then find their places by their
rank among those of equal length, which is counted in spread-out groups, so one very common length is no hot
group, and no piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import slices, texts_of, written
from packwright.llm.word_tokens import word_ids

CAPACITY = 2048
#: Groups in which equal lengths are ranked; capacity * groups bounds the table of their first ranks.
GROUPS = 256


def pieces(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if wanted, ids. Only documents of more than
    `capacity` ids (the closing `end_id` included) have several pieces; a null text is empty: its end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(vocabulary)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in slices(batches, "text"):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, value in enumerate(texts_of(batch.column("text"))):
                data = ids_of.encode(value) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at >> 2)
                    length.append(len(part) >> 2)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [
                batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long{more}"
    ).withColumnRenamed("id", id_column)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Fillings as (how many sequences, the lengths in one of them)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        avail, filling, gap = left.copy(), [], capacity
        while len(fit := np.flatnonzero(avail[: gap + 1])):
            filling.append(int(fit[-1]))
            avail[fit[-1]] -= 1
            gap -= int(fit[-1])
        if gap and (pair := _tighter_pair(avail, filling[-1], gap)):
            filling[-1:] = pair
        used = np.bincount(filling, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        out.append((times, sorted(filling, reverse=True)))
    return out


def _tighter_pair(avail: np.ndarray, smallest: int, gap: int) -> list[int] | None:
    """The two available lengths of largest sum within smallest + gap, if that is more than smallest."""
    room = smallest + gap
    lengths = np.flatnonzero(avail[: room + 1])
    if not len(lengths):
        return None
    # Partner of a: the largest available length <= room - a; if that is a itself, there must be two of it.
    at = np.searchsorted(lengths, room - lengths, "right") - 1
    at[(at >= 0) & (lengths[at] == lengths) & (avail[lengths] < 2)] -= 1
    ok = at >= 0
    if not ok.any():
        return None
    a, b = lengths[ok], lengths[at[ok]]
    best = int(np.argmax(a + b))
    return [int(a[best]), int(b[best])] if a[best] + b[best] > smallest else None


def _slots(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset in it), by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for length in dict.fromkeys(filling):
            per = filling.count(length)
            rows.append((length, taken.get(length, 0), per, sequence, offset))
            taken[length] = taken.get(length, 0) + times * per
            offset += per * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(sized: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Rows with their length (1 to `capacity`) as they are, with sequence_id and offset added.

    Sequences are gapless from offset 0. Rows that are equal in all columns may change places. An empty table
    gives no row.
    """
    keys = [F.col(f"`{c}`") for c in sized.columns]
    # Arrays and the like cannot be sorted by all engines' rules, but their hash can.
    grouped = sized.withColumn("_h", F.xxhash64(*keys)).withColumn("_group", F.pmod("_h", F.lit(GROUPS)))
    counts = written(grouped.groupBy(F.col(length).alias("_l"), "_group").agg(F.count("*").alias("n")), "lengths")
    plan = best_two_fit({r["_l"]: r["n"] for r in counts.groupBy("_l").agg(F.sum("n").alias("n")).collect()}, capacity)
    slots = _slots(plan)
    # At most capacity * GROUPS rows.
    before = Window.partitionBy("_l").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_l", "_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    ranked = grouped.withColumnRenamed(length, "_l").withColumn(
        "_at", F.row_number().over(Window.partitionBy("_l", "_group").orderBy("_h")) - 1
    ).join(F.broadcast(firsts), ["_l", "_group"]).withColumn("_rank", F.col("_first") + F.col("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("_l", "_rank"))
            at = np.searchsorted(key, size.astype(np.int64) << 44 | rank, "right") - 1
            copy, i = np.divmod(rank - slots[at, 1], slots[at, 2])
            rest = batch.select([n for n in batch.schema.names if n not in ("_l", "_rank")])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, batch.column("_l"), pa.array(slots[at, 3] + copy), pa.array(slots[at, 4] + i * size)],
                names=[*rest.schema.names, length, "sequence_id", "offset"],
            )

    rest = [c for c in sized.columns if c != length]
    fields = "".join(f"`{c}` {sized.schema[c].dataType.simpleString()}, " for c in rest)
    kind = sized.schema[length].dataType.simpleString()
    return ranked.select(*[F.col(f"`{c}`") for c in rest], "_l", "_rank").mapInArrow(
        run, f"{fields}`{length}` {kind}, sequence_id long, `offset` long"
    )


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """All documents, cut only where longer than a sequence, with the sequence and offset of each piece.

    Defined cases: a null or empty text is its closing id alone; null ids and repeated rows are documents like
    any other; other columns are not read.
    """
    made = written(pieces(docs, id_column, text_column, capacity, vocabulary, with_ids=with_ids), "pieces")
    return pack(made, "length", capacity)
