"""Small helpers the training-data operators share: rows as values, words, hashes, scratch tables."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.session import freeze, scratch_dir

#: The six characters that separate words: space and \t \n \v \f \r.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Entries a worker's cache may hold; it is emptied beyond that, so memory has a bound.
CACHE_ENTRIES = 300_000
#: Odd multiplier of the rolling hashes. 5 modulo 8, so that its powers differ in their low bits.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame below `spark.checkpoint.dir` and read it back: lineage ends here, and shuffle files that
    only the old lineage needed may go, because the driver is asked to collect what nothing refers to."""
    out = freeze(df, f"{scratch_dir(df.sparkSession, purpose)}/table")
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text, natively; an empty array if it has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for as many words as the bound allows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash so that all its bits are usable (64-bit avalanche)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, by prefix sums; empty if there are fewer words."""
    n = len(word_hashes)
    if n < size:
        return np.empty(0, np.uint64)
    up, down = powers(n + size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes * up[:n], dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *more.values()], names=[*batch.schema.names, *more]
    )


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 16 << 20):
    """Batches cut so that one holds about `most` bytes of text; a longer text has one of its own."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column).cast(pa.large_binary()))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
