"""Collocations: phrases of a few words that occur together more often than their parts would by chance.

Method. Rabin-Karp fingerprints, level by level:
    1. Prefix sums of polynomials over the bytes of a slice of texts give a hash of every word, and prefix sums
       over those one of every run of words (numpy, no loop over words). A fingerprint holds the language, 64 bits
       of one polynomial and 32 of another over different byte values.
    2. Occurrences with equal fingerprints are summed up in the task, and shuffled as (fingerprint, count,
       pointer); a pointer is a text and the place of a word in it, and the smallest one survives. Runs of n words
       are only looked at where the runs of fewer words inside them are frequent, which a Bloom filter of those
       tells; what it lets through in vain is counted like the rest.
    3. Frequent fingerprints alone are read back at their pointers. The words found there are hashed once more and
       must give the fingerprint, so a text that only shares the pointer's key is not taken, and two phrases that
       share 64 bits are told apart.
Scores, cuts and what a longer phrase covers are joins of the frequent phrases.

Scale. Counts are summed before every shuffle, so a word in every text is no hot group. The smallest pointers lie
in few texts: only texts with a key up to the largest one needed are read back. The filter has 16 bits for each
frequent run, at most FILTER_BITS in all; beyond that it sorts out less, and the counts stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import mixed, powers, slices, text_or_empty, texts_of, window_hashes, written

MIN_COUNT = 100
LONGEST = 5
FIRST = 2000
#: A phrase goes if a longer one has at least so many hundredths of its occurrences.
COVERED = 100
#: Bits of the filter of frequent runs: 16 MiB.
FILTER_BITS = 1 << 27
#: Bytes of text that are hashed together, and occurrences that are summed up together.
SLICE_BYTES = 2 << 20
SUMMED = 2_000_000
#: A pointer is 39 bits of its text's key and 24 of the word's place; later words have the last place.
PLACE_BITS = 24
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Groups a language's phrases are dealt to until few are left, so that one language is no hot group.
GROUPS = 256

NO_LANG = "und"
_CASE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPLIT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)

_KEY = ["size", "fp", "also"]


def normal(text: bytes) -> bytes:
    """Lower case; words divided by spaces, pieces by line feeds."""
    return text.translate(_CASE).translate(_SPLIT)


class Words:
    """The words of some texts: hashes, pieces, and where they stand."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        data = np.frombuffer(normal(b"\n".join(texts)) + b"\n", np.uint8)
        ends_piece = data == 0x0A
        gap = ends_piece | (data == 0x20)
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        start, end = edge[::2], edge[1::2]
        up, down = powers(len(data) + 1)
        self.hashes = []
        for values in _VALUES:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])
            self.hashes.append(mixed((sums[end] - sums[start]) * down[start]))
        self.piece = np.cumsum(ends_piece, dtype=np.int32)[start]
        # The number of each word's text, and its place among the words there.
        first_byte = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first_word = np.searchsorted(start, first_byte)
        self.sizes = np.diff(first_word)
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(start)) - np.repeat(first_word[:-1], self.sizes)
        self._lang = langs[self.text]

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, fingerprint, its other 32 bits) of every run of `size` words that lies in one piece."""
        last = len(self.place) - size + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
        inside = self.piece[:last] == self.piece[size - 1 :]
        at = np.flatnonzero(inside)
        first, second = (mixed(window_hashes(h, size)[at] + self._lang[at]) for h in self.hashes)
        return at, first, (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def lang_hashes(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang in langs], np.uint64)


def _places(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return fp & mask, (fp >> np.uint64(32)) & mask


def _maybe(fp: np.ndarray, known: np.ndarray) -> np.ndarray:
    found = np.ones(len(fp), bool)
    for place in _places(fp, len(known) * 64):
        found &= (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    return found


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """The fingerprints as a Bloom filter of two bits each, in 64-bit words: bounded, whatever their number."""
    bits = 1 << 16
    n = frequent.count()
    while bits < FILTER_BITS and bits < 16 * n:
        bits *= 2
    mask = F.lit(bits - 1)
    place = F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask)))
    words = frequent.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


class _Sums:
    """Occurrences, summed up by fingerprint whenever there are many."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._n = 0

    def add(self, size: int, fp: np.ndarray, also: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._parts.append((np.full(len(fp), size, np.int8), fp, also, at))
        self._n += len(fp)
        if self._n >= SUMMED:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self._n:
            return
        size, fp, also, at = (np.concatenate(p) for p in zip(*self._parts, strict=True))
        self._parts, self._n = [], 0
        order = np.argsort(fp)
        size, fp, also, at = size[order], fp[order], also[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (also[1:] != also[:-1]) | (size[1:] != size[:-1])]))
        counts, least = np.diff(np.append(new, len(fp))), np.minimum.reduceat(at, new)
        yield from _batches(None, size[new].astype(np.int32), fp[new].view(np.int64), also[new], counts, least)


def _batches(lang: list[str] | None, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    langs = pa.nulls(n, pa.string()) if lang is None else pa.array(lang, pa.string())
    table = pa.RecordBatch.from_arrays([langs, *map(pa.array, columns)], names=["lang", *_KEY, "n", "at"])
    for start in range(0, n, 200_000):
        yield table.slice(start, 200_000)


def _counted(texts: DataFrame, sizes: list[int], known: tuple[int, np.ndarray] | None, least: int) -> DataFrame:
    """(size, fp, also, n, at) of frequent runs; with the first level also the words of each lang, as (lang, n)."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals, known = _Sums(), {}, shared.value
        for batch in slices(batches, "text", SLICE_BYTES):
            langs = batch.column("lang").to_pylist()
            words = Words(texts_of(batch.column("text")), lang_hashes(langs))
            if known is None:
                for lang, n in zip(langs, words.sizes.tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
            else:
                part, bits = known
                at, fp, _ = words.runs(part)
                frequent = np.zeros(len(words.place), bool)
                frequent[at[_maybe(fp, bits)]] = True
            pointer = (batch.column("short").to_numpy()[words.text] << PLACE_BITS) + np.minimum(words.place, LAST_PLACE)
            for size in sizes:
                at, fp, also = words.runs(size)
                if known is not None:
                    take = frequent[at]
                    for i in range(1, size - part + 1):
                        take = take & frequent[at + i]
                    at, fp, also = at[take], fp[take], also[take]
                yield from sums.add(size, fp, also, pointer[at])
        yield from sums.rows()
        if totals:
            n, zero = np.array(list(totals.values())), np.zeros(len(totals), np.int64)
            yield from _batches(list(totals), zero.astype(np.int32), zero, zero.astype(np.int32), n, zero)

    rows = texts.mapInArrow(run, "lang string, size int, fp long, also int, n long, at long")
    return rows.groupBy("lang", *_KEY).agg(F.sum("n").alias("n"), F.min("at").alias("at")).where(
        F.col("lang").isNotNull() | (F.col("n") >= least)
    )


def _read_back(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, phrase, size, n): the words at each frequent fingerprint's pointer, if they hash to it."""
    short = F.shiftright("at", PLACE_BITS)
    most = frequent.agg(F.max(short).alias("m")).first().m
    wanted = frequent.groupBy(short.alias("short")).agg(
        F.collect_list(F.struct("size", "fp", "also", "n", F.col("at").bitwiseAND(F.lit(LAST_PLACE)).alias("place"))).alias("wanted")
    )
    once = texts.where(F.col("short") <= F.lit(-1 if most is None else most)).groupBy(
        "short", "lang", F.md5("text").alias("digest")
    ).agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            out: list[list] = [[], [], [], []]
            langs, lists = batch.column("lang").to_pylist(), batch.column("wanted")
            for i, text in enumerate(texts_of(batch.column("text"))):
                words, found = normal(text).split(), Words([text], lang_hashes([langs[i]]))
                asked = {name: lists[i].values.field(name).to_numpy() for name in ("size", "fp", "also", "n", "place")}
                for size in np.unique(asked["size"]).tolist():
                    at, fp, also = found.runs(size)
                    mine = np.flatnonzero(asked["size"] == size)
                    for k in mine.tolist():
                        place = int(asked["place"][k])
                        j = int(np.searchsorted(at, place))
                        late = place == LAST_PLACE
                        near = np.arange(j, len(at) if late else min(j + 1, len(at)))
                        same = near[(fp[near].view(np.int64) == asked["fp"][k]) & (also[near] == asked["also"][k])]
                        if len(same) and (late or at[same[0]] == place):
                            a = int(at[same[0]])
                            out[0].append(langs[i])
                            out[1].append(b" ".join(words[a : a + size]))
                            out[2].append(size)
                            out[3].append(int(asked["n"][k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()).cast(pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())],
                names=["lang", "phrase", "size", "n"],
            )

    return once.join(wanted, "short").select("lang", "text", "wanted").mapInArrow(
        run, "lang string, phrase string, size int, n long"
    ).dropDuplicates(["lang", "phrase"])


def frequent_phrases(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = MIN_COUNT
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of every run of one to `longest` words that occurs `least` times, and (lang, words)."""
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANG)).alias("lang")
    texts = docs.select(lang, text_or_empty(text_column).alias("text")).withColumn(
        "short", F.shiftrightunsigned(F.xxhash64("lang", "text"), 25)
    )
    found = written(_counted(texts, [1], None, least), "words")
    totals = found.where("lang is not null").select("lang", F.col("n").alias("words"))
    level = found.where("lang is null")
    frequent, size = level, 1
    while size < longest and not level.isEmpty():
        # Three words that occur often are rare enough to look at all longer runs at once.
        sizes = [size + 1] if size < 3 else list(range(size + 1, longest + 1))
        level = written(_counted(texts, sizes, (size, frequent_filter(level)), least), "runs")
        frequent, size = frequent.union(level), sizes[-1]
    return written(_read_back(texts, frequent), "phrases"), totals


def _joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    longest: int = LONGEST,
    least: int = MIN_COUNT,
    first: int = FIRST,
    covered: int = COVERED,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of each language.

    `a` is how often the phrase occurs, `l` and `r` how often its parts do where it is cut so that the score
    1000 * a * n / (l * r), rounded down, is lowest; `n` counts the language's words. A phrase goes if a longer
    one, itself dropped or not, holds it and has `covered` hundredths of its occurrences. Arithmetic is exact
    (38 digits). Defined cases: a null language is `und`; a null or empty text has no word; repeated rows count
    each time; ids and other columns play no part; equal scores go by `a`, then by the phrase's bytes; an empty
    table, or one without frequent phrases, gives no row.
    """
    counts, totals = frequent_phrases(docs, text_column, lang_column, longest, least)
    words = F.split("phrase", " ", -1)
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*", _joined(words, F.lit(1), F.col("k")).alias("left"), _joined(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = "(cast(1000 * a as decimal(19,0)) * cast(words as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).cast("int")
    spread = totals.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("_g", group).join(spread, ["lang", "_g"])
    best = scored.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: _joined(words, i, s)),
    ))
    longer = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer")
    )
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    ).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("_g", group).withColumn(
        "_r", F.row_number().over(Window.partitionBy("lang", "_g").orderBy(*order))
    ).where(F.col("_r") <= first)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(
    table: str = "documents", longest: int = LONGEST, least: int = MIN_COUNT, first: int = FIRST, covered: int = COVERED
) -> str:
    """The same in DuckDB."""
    return f"""
        WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {table}),
            words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
            totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
            runs AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
                FROM words, unnest(range(1, {longest + 1})) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
            counts AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {least}),
            cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, string_split(c.phrase, ' ') AS w
                FROM counts c, unnest(range(1, c.k)) AS t(j) WHERE c.k > 1),
            scored AS (SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r, n,
                    CAST((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
                FROM cuts c JOIN totals t ON t.lang = c.lang
                JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ')
                JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
            best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
            inner_ AS (SELECT c.lang, array_to_string(list_slice(string_split(c.phrase, ' '), i, i + s - 1), ' ') AS phrase,
                    max(c.f) AS f
                FROM counts c, unnest(range(2, c.k)) AS t(s), unnest(range(1, c.k - s + 2)) AS u(i) GROUP BY ALL),
            kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
                WHERE i.f IS NULL OR 100 * i.f < {covered} * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept QUALIFY rank <= {first}"""
