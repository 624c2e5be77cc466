"""Token ids as Parquet list columns, laid out for selective reads.

Format. `<path>/data` has a row per document in ascending id order, file by file and row by row:

    part       number of the file; files follow each other in this order
    <id>       the document's id
    position   ids of all documents before it in its file
    n_tokens   its ids, the end id included
    ids        array<int>
    row        struct of the document's other columns, its text left out

`<path>/parts` has a row per file: part, documents, tokens, start (ids of all files before it). So a document's
global start is start + position, and no row had to wait for the files before it.

Ids are dictionary encoded (a vocabulary's numbers fit one dictionary page, so an id takes as many bits as the
file's distinct ids need) or, on wish, delta encoded. Row groups have a bounded size, and pages a bounded number
of rows: with the column and offset indexes Parquet writes, a reader of a few documents or of a stretch of the
token stream opens their pages only, and one that wants metadata never touches the ids.

Scale. One range shuffle by id, repeated ids told apart by their text; the tokenizer runs in the sorted
partitions, whose rows go straight to the files. The driver sees one row per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.llm.byte_tokens import byte_ids
from packwright.llm.common import slices

#: Bytes of a row group before compression, and rows of a page at most.
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 256
#: Bytes of text that are encoded together.
SLICE_BYTES = 4 << 20
ENCODINGS = ("dictionary", "delta")


def write_token_files(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode every whole text, with `end_id` after it, and write the files to `path`, which must be free.

    Defined cases: a null or empty text has the end id alone; rows of a null id come first; rows that share an id
    are all kept, side by side, in an order their texts fix; columns of any other name, `part` or `ids` say,
    stay inside `row`; an empty table gives files without rows and a `parts` table without rows.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}: {encoding!r}")
    others = [F.col(c) for c in docs.columns if c not in (id_column, text_column)]
    row = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), row.alias("row"))
    spread = F.xxhash64("text")
    placed = rows.repartitionByRange("id", spread).sortWithinPartitions("id", spread, "text")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("id", kinds["id"]),
        T.StructField("position", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("row", kinds["row"]),
    ])
    encoded = placed.select(F.spark_partition_id().alias("part"), "id", "text", "row").mapInArrow(
        _encoder(vocabulary, end_id), schema
    )
    writer = encoded.select("part", F.col("id").alias(id_column), "position", "n_tokens", "ids", "row").write
    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows, "maxRecordsPerFile": 0,
    }
    if encoding == "delta":
        options |= {"parquet.writer.version": "v2", "parquet.enable.dictionary#ids.list.element": "false"}
    writer.options(**options).parquet(f"{path}/data")
    _write_parts(docs.sparkSession, path)


def _encoder(vocabulary: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, position = byte_ids(vocabulary), np.uint32(end_id).astype("<u4").tobytes(), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            data = [ids + end for ids in encoder.encode(batch.column("text").to_pylist())]
            sizes = np.fromiter(map(len, data), np.int64, len(data)) >> 2
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(data), "<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part"), batch.column("id"), pa.array(position + ends[:-1]), pa.array(sizes), ids,
                    batch.column("row"),
                ],
                names=["part", "id", "position", "n_tokens", "ids", "row"],
            )
            position += int(ends[-1])

    return run


def _write_parts(spark: SparkSession, path: str) -> None:
    """Sum up each file, from its metadata columns only, and add up the files: one row per file."""
    totals = (
        spark.read.parquet(f"{path}/data").groupBy("part")
        .agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
        .orderBy("part").collect()
    )
    starts = np.concatenate([[0], np.cumsum([r.tokens for r in totals], dtype=np.int64)])
    parts = [(r.part, r.documents, r.tokens, int(s)) for r, s in zip(totals, starts, strict=False)]
    table = spark.createDataFrame(parts, "part int, documents long, tokens long, start long")
    table.coalesce(1).write.parquet(f"{path}/parts")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/parts")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All documents with their global `start`. Columns that are not asked for are not read, and conditions on the
    id, `position`, `n_tokens` or fields of `row` reach the pages; select without `ids` for metadata only."""
    starts = {r.part: r.start for r in read_parts(spark, path).collect()}
    data = spark.read.parquet(f"{path}/data")
    # One number per file, by its place in an array: no join, no shuffle.
    start = F.lit(np.array([starts.get(p, 0) for p in range(max(starts, default=0) + 1)], np.int64))
    return data.withColumn("start", F.get(start, F.col("part")) + F.col("position")).drop("part", "position")


def read_stretch(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids at global places `first` up to, not including, `last`: a row per document that has some of them, with
    `start` and `ids` cut to the stretch. Only files, row groups and pages that hold such documents are read."""
    hit = read_parts(spark, path).where((F.col("start") < last) & (F.col("start") + F.col("tokens") > first)).collect()
    data = spark.read.parquet(f"{path}/data")
    inside = F.lit(False)
    for r in hit:
        near = (F.col("part") == r.part) & (F.col("position") < last - r.start)
        inside = inside | (near & (F.col("position") + F.col("n_tokens") > first - r.start))
    base = F.create_map(*[F.lit(x) for r in hit for x in (r.part, r.start)]) if hit else F.lit(None).cast("map<int,long>")
    found = data.where(inside).withColumn("start", base[F.col("part")] + F.col("position"))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    take = (F.least(F.lit(last), F.col("start") + F.col("n_tokens")) - F.col("start")).cast("int") - skip
    return found.withColumn("ids", F.slice("ids", skip + 1, take)).withColumn("start", F.col("start") + skip).drop(
        "part", "position", "n_tokens"
    )


def with_crc32(documents: DataFrame) -> DataFrame:
    """The documents with ids_crc32, the checksum of their ids as little-endian unsigned 32-bit numbers, for ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            kept = [i for i, n in enumerate(batch.schema.names) if n != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(crc, pa.int64())],
                names=[*[batch.schema.names[i] for i in kept], "ids_crc32"],
            )

    kept = [f for f in documents.schema.fields if f.name != "ids"]
    return documents.mapInArrow(run, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))
