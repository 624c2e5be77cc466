"""Language-model scores by a probabilistic suffix tree, over words and, below them, over letters.

Method. A tree's contexts are the last symbols before the next one: a context is retained if it was seen
MIN_COUNT times or more and its next symbols diverge from those after its suffix (N * KL beyond a price of
PENALTY * ln(N) / 2 for each different one); nothing else decides, whatever the size of the corpus.
Distributions are smoothed by the shorter suffix, and scoring uses the longest retained one. Two such trees:
one of texts, whose symbols are words and an end, and one of words, whose symbols are letters (bytes) and an
end; it learns from each different training word once. Every training word has its own discounted share in the
root of the upper tree, the discount goes to the letters. So every word has a probability, and those of all
texts of a length sum to one or less.
A depth's contexts are those of the depth before with one more symbol in front, where that one was retained; the
trees end at the depth that retains none.
Scale. Texts are read once and kept as numbers, in chunks of some MB. A place (the symbols before a symbol, and
it) is dealt once, to the task that has all places of its contexts; that task grows these subtrees, level by level, and
scores the places, of training or not, at once, so neither tree is ever a table. Tasks are ranges of contexts, read
backwards, cut where samples of places say (that decides where work is done, not what comes out); only contexts
that a cut divides, none of them rare, have their counts summed beforehand. Places travel with REACH symbols; those
whose context of that depth was retained go on with twice as many. Ranges are taken in PASSES, and a pass's
shuffle may go before the next, so disk holds a part of the places at a time.
Words with a share of more than 1 / FREQUENT, fewer than FREQUENT by that rule, have a small number and travel
with every task; the others meet their counts once a chunk.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm.common import BASE, slices
from packwright.session import freeze, scratch_dir
from packwright.storage import Storage

FREQUENT, DISCOUNT = 500_000, 0.75
#: Fewest times that a retained context was seen.
MIN_COUNT = 2
#: How much evidence a context must bring beyond its suffix (1: as the Bayesian information criterion).
PENALTY = 1.0
SYMBOLS = 257
#: What stands before a sequence and after it; letters are their byte plus LETTER, words count on from there.
START, END, LETTER = 1, 2, 3
#: Bytes of text in a chunk; words that chunks have, copies too, that are counted together.
TEXT_BYTES, WORDS = 8 << 20, 250_000
#: Symbols before a place that travel with it at first, in the tree of texts and in that of words.
REACH, LETTER_REACH = 4, 6
#: Places of a range, about; samples taken of that many; turns in which ranges are taken.
PART, SAMPLED, PASSES = 600_000, 64, 4


def held_out(id_: Column) -> Column:
    """crc32 of the id as text is divisible by ten; rows without id are for training."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


class _Scratch:
    """Tables below the scratch folder, deleted when their last reader is done."""

    def __init__(self, session: SparkSession):
        self.session, self.paths = session, {}

    def written(self, frame: DataFrame, purpose: str) -> DataFrame:
        path = f"{scratch_dir(self.session, purpose)}/table"
        out = freeze(frame, path)
        self.paths[id(out)] = (out, path)
        # Shuffle files go when the driver has collected what they belong to.
        del frame
        gc.collect()
        self.session._jvm.System.gc()
        return out

    def done(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.paths.pop(id(frame))[1]
            Storage(self.session, path).delete(path)


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers from zero, or floats, as bytes by place value, compressed."""
    head, planes = [len(arrays)], []
    for a in arrays:
        whole = a.dtype.kind != "f"
        a = np.ascontiguousarray(a)
        width = (int(a.max(initial=0)).bit_length() + 7) // 8 if whole else 8
        head += [len(a), width, whole]
        planes.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T[:width].tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    number = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 3 * number, 8).tolist()
    at, out = 8 + 24 * number, []
    for size, width, whole in zip(head[::3], head[1::3], head[2::3], strict=True):
        a = np.zeros((size, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(a.reshape(-1).view(np.int64 if whole else np.float64))
        at += size * width
    return out


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return order, new


def _ordered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the columns, the first one first, and where in it a different row begins."""
    key, width = np.zeros(len(columns[0]), np.uint64), 0
    for column in columns:
        bits = int(column.max(initial=0)).bit_length()
        if width + bits > 64:
            order, new = _sorted(key)
            key[order] = np.cumsum(new)
            width = int(key.max(initial=0)).bit_length()
        key <<= np.uint64(bits)
        key |= column.astype(np.uint64, copy=False)
        width += bits
    return _sorted(key)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Rank of each row among the different rows."""
    order, new = _ordered(*columns)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _hash(*columns: np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        h = (h + column.astype(np.uint64)) * np.uint64(BASE)
        h ^= h >> np.uint64(32)
    return h


def _range(columns: list[np.ndarray], prefix: tuple[int, ...]) -> tuple[int, int]:
    """Rows of sorted columns that begin with a prefix; if none does, where they would be."""
    low, high = 0, len(columns[0])
    for column, value in zip(columns, prefix):
        low, high = (low + int(np.searchsorted(column[low:high], column.dtype.type(value), side)) for side in ("left", "right"))
    return low, high


class _Places:
    """Places of a chunk: up to `depth` symbols before each (zero: none), it, its sequence, whether it is learned
    from, share and chance of it after the context it comes with, and which place of the chunk it is."""

    def __init__(self, before, *others):
        self.before, (self.symbol, self.sequence, self.learn, self.share, self.chance, self.at) = before, others


def _body(codes, lengths, learn, numbers, c, p) -> bytes:
    """Sequences as codes from LETTER on, of which `numbers` gives the symbols, in their order; count and log10 chance
    of the last of them, which are not common."""
    return packed(codes, lengths, learn, numbers, c, p)


def _places(
    body: bytes, depth: int, common: tuple[np.ndarray, np.ndarray, int], going_on: bool = False, wanted: Callable | None = None,
    only: np.ndarray | slice = slice(None),
) -> _Places:
    """`wanted` tells from the last symbol before them which places are, `only` picks from these."""
    if going_on:
        *before, symbol, sequence, learn, share, chance = unpacked(body)
        at = (np.flatnonzero(wanted(before[0])) if wanted else np.arange(len(symbol)))[only]
        return _Places([b[at] for b in before], *(x[at] for x in (symbol, sequence, learn, share, chance)), at)
    codes, lengths, learn, numbers, c, p = unpacked(body)
    if numbers[-1] < 1 << 32:
        numbers = numbers.astype(np.uint32)
    ends = np.cumsum(lengths + 2)
    begins = ends - lengths - 2
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = inner[begins] = False
    flat[inner], flat[ends - 1], flat[begins] = codes, END, START
    del codes
    inner[:] = True
    inner[begins] = False
    if wanted:
        # By code, since `numbers` has each once.
        inner[1:] &= wanted(numbers)[flat[:-1]]
    at = np.flatnonzero(inner)[only]
    sequence = np.searchsorted(begins, at, "right") - 1
    place = at - begins[sequence]
    before = [numbers[flat[np.maximum(at - k, 0)]] * (place >= k) for k in range(1, depth + 1)]
    code = flat[at]
    # The rare ones are the last of `numbers`.
    often = numbers[: len(numbers) - len(c)]
    share, chance = np.concatenate([common[0][often], c / common[2]]), np.concatenate([common[1][often], 10.0**p])
    return _Places(before, numbers[code], sequence, learn[sequence], share[code], chance[code], at)


class _Plan:
    """How places are dealt: `borders`, beginnings of contexts at which ranges begin, and contexts they divide."""

    def __init__(self, samples: np.ndarray, parts: int, start: int):
        self.borders: list[tuple[int, ...]] = []
        if parts > 1 and len(samples):
            samples = samples[np.lexsort(samples.T[::-1])]
            last: tuple[int, ...] = ()
            for row in samples[[len(samples) * j // parts for j in range(1, parts)]].tolist():
                same = next((i for i, (a, b) in enumerate(zip(row, last)) if a != b), len(last))
                if same < len(row):
                    self.borders.append(tuple(row[: same + 1]))
                    last = tuple(row)
        divided = {b[:k] for b in self.borders for k in range(start + 1, len(b)) if 0 not in b[:k]}
        self.divided = {c: i for i, c in enumerate(sorted(divided))}

    def near(self, part: int) -> list[tuple[int, ...]]:
        """Divided contexts that a range may have places of, the short ones first."""
        sides = self.borders[max(0, part - 1) : part + 1]
        return sorted({b[:k] for b in sides for k in range(1, len(b)) if b[:k] in self.divided}, key=len)


def _cut(columns: list[np.ndarray], borders: list[tuple[int, ...]]) -> np.ndarray:
    """Where each range begins in sorted columns, and their end."""
    return np.array([0, *(_range(columns, b)[0] for b in borders), len(columns[0])])


def _subtrees(before, symbol, n, share, chance, start, divided, totals):
    """What contexts deeper than `start` add to the log10 probability of each (context, symbol), and the rows whose
    context of all symbols given is retained, with the share and chance that their symbol has there.

    `n`: how often the row is learned from. `divided`: context -> (kept, total, own) where others have places of it,
    too; `totals`: context -> (symbols, n) of all places."""
    size = len(symbol)
    added, share, chance = np.zeros(size), share.copy(), chance.copy()
    # Symbols by rank: context, one more symbol and the next then fit one key.
    live, code = np.arange(size), _ranks(symbol)
    context = _ranks(*before[:start]) if start else np.zeros(size, np.int64)
    for depth in range(start + 1, len(before) + 1):
        last = before[depth - 1][live]
        on = last > 0
        live, context, last = live[on], context[on], last[on]
        if not len(live):
            break
        order, new = _ordered(context, last, code[live])
        live, context, last = live[order], context[order], last[order]
        changes = np.ones(len(live), bool)
        changes[1:] = (context[1:] != context[:-1]) | (last[1:] != last[:-1])
        context, pair, begin = np.cumsum(changes) - 1, np.cumsum(new) - 1, np.flatnonzero(new)
        of, row = context[begin], live[begin]
        times = np.add.reduceat(n[live], begin).astype(float)
        kept_by_others = []
        for c, (kept, total, own) in divided.items():
            if len(c) == depth:
                hit = np.ones(len(row), bool)
                for b, value in zip(before, c):
                    hit &= b[row] == value
                if (hit := np.flatnonzero(hit)).size:
                    if kept:
                        symbols, counts = totals[c]
                        times[hit] = counts[np.searchsorted(symbols, symbol[row[hit]])]
                    kept_by_others.append((of[hit[0]], kept, total, own))
        total, own = np.bincount(of, times), np.bincount(of, times > 0)
        seen = np.flatnonzero((times > 0) & (total >= MIN_COUNT)[of])
        times_, of_ = times[seen], of[seen]
        gain = np.bincount(of_, times_ * (np.log(times_ / total[of_]) - np.log(share[row[seen]])), len(total))
        kept = (total >= MIN_COUNT) & (gain >= PENALTY * np.log(np.maximum(total, 1)) * own / 2)
        for c, *values in kept_by_others:
            kept[c], total[c], own[c] = values
        stays = np.flatnonzero(kept[of])
        of, row, times = of[stays], row[stays], times[stays]
        weight = total[of] + own[of]
        rest = own[of] / weight
        p = times / weight + rest * chance[row]
        plus = np.log10(np.where(times > 0, p / np.where(times > 0, chance[row], 1), rest))
        on = kept[context]
        live, context, pair = live[on], context[on], pair[on]
        pair = np.searchsorted(stays, pair)
        added[live] += plus[pair]
        share[live], chance[live] = (times / total[of])[pair], p[pair]
    else:
        live = np.sort(live)
        return added, live, share[live], chance[live]
    return added, live[:0], share[:0], chance[:0]


def _mapped(frame: DataFrame, columns: tuple[str, ...], schema: str, each: Callable) -> DataFrame:
    """`each(values of a row)` gives tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for out in each(*(batch.column(c)[i].as_py() for c in columns)):
                    yield from out.to_batches()

    return frame.select(*columns).mapInArrow(run, schema)


def _table(kinds: str, *columns) -> pa.Table:
    kind = {"l": pa.int64(), "f": pa.float64(), "b": pa.binary(), "i": pa.int32()}
    names, kinds = zip(*(k.split(":") for k in kinds.split()))
    return pa.table([pa.array(c, kind[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _samples(source: DataFrame, depth: int, places: int, parts: int, common: Broadcast, going_on: bool) -> np.ndarray:
    step = max(1, places // (parts * SAMPLED))

    def each(chunk: int, body: bytes):
        before = _places(body, depth, common.value, going_on, only=slice(chunk % step, None, step)).before
        yield _table("body:b", [packed(*before)])

    rows = [unpacked(r.body) for r in _mapped(source, ("chunk", "body"), "body binary", each).toLocalIterator()]
    return np.concatenate([np.stack(r, 1) for r in rows]) if rows else np.empty((0, depth), np.int64)


def _divided(scratch, source, plan, start, depth, common, going_on):
    """For the contexts that borders divide: context -> (kept, total, own), and a table (part, body) of how often each
    symbol of a range follows them anywhere."""
    if not plan.divided:
        return {}, None
    borders, numbers, parts = plan.borders, plan.divided, len(plan.borders) + 1
    deep = max(map(len, borders))
    firsts = np.unique([c[0] for c in numbers])
    up = np.array([numbers.get(c[:-1], -1) for c in sorted(numbers, key=numbers.get)])

    def deal(chunk: int, body: bytes):
        places = _places(body, deep, common.value, going_on, lambda last: np.isin(last, firsts))
        if not len(places.symbol):
            return
        order, new = _ordered(*places.before[:deep], places.symbol)
        begin = np.flatnonzero(new)
        n = np.add.reduceat(places.learn[order], begin)
        first = order[begin]
        before, symbol, share = [b[first] for b in places.before[:deep]], places.symbol[first], places.share[first]
        cuts = _cut(before, borders)
        found = []
        for c, i in numbers.items():
            low, high = _range(before, c)
            inner = cuts[(cuts > low) & (cuts < high)]
            for a, b in zip([low, *inner], [*inner, high]):
                if a < b:
                    symbols, first, of = np.unique(symbol[a:b], return_index=True, return_inverse=True)
                    part = int(np.searchsorted(cuts[:-1], a, "right")) - 1
                    times = np.bincount(of, n[a:b]).astype(np.int64)
                    found.append((np.full(len(symbols), part), np.full(len(symbols), i), symbols, times, share[a:b][first]))
        if found:
            found = [np.concatenate(x) for x in zip(*found)]
            turn = found[2] % parts
            order = np.argsort(turn)
            ends = np.searchsorted(turn[order], np.arange(parts + 1))
            rows = [(i, packed(*(x[order[a:b]] for x in found))) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]
            yield _table("turn:i body:b", *zip(*rows))

    def add(table: pa.Table) -> pa.Table:
        part, context, symbol, n, share = (np.concatenate(x) for x in zip(*map(unpacked, table.column("body").to_pylist())))
        # A symbol is in one turn with all its contexts, so also with the shorter ones.
        above = up[context]
        pair = _ranks(np.concatenate([context, above]) + 1, np.concatenate([symbol, symbol]))
        pair, shorter = pair[: len(context)], pair[len(context) :]
        times = np.bincount(pair, n, int(max(pair.max(), shorter.max())) + 1)
        row = np.unique(pair, return_index=True)[1]
        row = row[times[pair[row]] > 0]
        of, n = context[row], times[pair[row]]
        m = np.where(above[row] >= 0, times[shorter[row]], share[row])
        sums = np.bincount(of, n * (np.log(n) - np.log(m)), len(up))
        total, own = np.bincount(of, n, len(up)), np.bincount(of, minlength=len(up))
        order, new = _ordered(part, context, symbol)
        order = order[new]
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [
            (i, packed(context[order[a:b]], symbol[order[a:b]], times[pair[order[a:b]]].astype(np.int64)))
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
        ]
        rows.append((-1, packed(total, own.astype(float), sums)))
        return _table("part:i body:b", *zip(*rows))

    dealt = _mapped(source, ("chunk", "body"), "turn int, body binary", deal)
    table = scratch.written(dealt.groupBy("turn").applyInArrow(add, "part int, body binary"), "divided")
    total, own, gain = (np.zeros(len(up)) for _ in range(3))
    for r in table.where("part < 0").toLocalIterator():
        for all_, some in zip((total, own, gain), unpacked(r.body), strict=True):
            all_ += some
    out = {}
    for c, i in sorted(numbers.items(), key=lambda x: len(x[0])):
        outer = 0.0 if up[i] < 0 else math.log(max(1, total[up[i]]))
        more = gain[i] + total[i] * (outer - math.log(max(1, total[i])))
        kept = (len(c) == start + 1 or out[c[:-1]][0]) and total[i] >= MIN_COUNT and more >= PENALTY * math.log(total[i]) * own[i] / 2
        out[c] = (bool(kept), total[i], own[i])
    return out, table


def _walk(scratch: _Scratch, chunks: DataFrame, depth: int, places: int, common: Broadcast, name: str) -> list[DataFrame]:
    """(chunk, sums): what retained contexts add to the log10 probability of each sequence of a chunk, in several
    tables. `chunks`: (chunk, body). `common`: share and chance in the root of symbols with small numbers."""
    out, source, start = [], chunks, 0
    while True:
        parts = max(1, math.ceil(places / PART))
        going_on = start > 0
        plan = _Plan(_samples(source, depth, places, parts, common, going_on) if parts > 1 else np.empty((0, depth), np.int64), parts, start)
        divided, totals = _divided(scratch, source, plan, start, depth, common, going_on)
        ends = sorted({len(plan.borders) * k // PASSES for k in range(1, PASSES)} - {0}) + [len(plan.borders) + 1]
        tables = [
            scratch.written(_grown(source, plan, range(a, b), start, depth, common, divided, totals), f"{name}{depth}_{b}")
            for a, b in zip([0, *ends], ends)
        ]
        if totals is not None:
            scratch.done(totals)
        if going_on:
            scratch.done(source)
        out += tables
        alive = None
        for t in tables:
            t = t.where("on is not null").select("chunk", "on")
            alive = t if alive is None else alive.union(t)
        if alive.isEmpty():
            return out
        source = scratch.written(_further(chunks, alive, depth, common), f"{name}{depth}_on")
        places = source.agg(F.sum("places")).first()[0]
        if not places:
            scratch.done(source)
            return out
        start, depth = depth, 2 * depth


def _grown(source, plan, parts, start, depth, common, divided, totals) -> DataFrame:
    """(chunk, sums, on) of the places in some ranges."""
    borders, going_on = plan.borders, start > 0
    low = borders[parts.start - 1] if parts.start else None
    high = borders[parts.stop - 1] if parts.stop <= len(borders) else None
    inside = borders[parts.start : parts.stop - 1]
    names = {i: c for c, i in plan.divided.items()}

    def deal(chunk: int, body: bytes):
        places = _places(
            body, depth, common.value, going_on, lambda last: (last >= (low[0] if low else 0)) & (last <= (high[0] if high else last)),
        )
        if not len(places.symbol):
            return
        order, new = _ordered(*places.before, places.symbol)
        begin = np.flatnonzero(new)
        n = np.add.reduceat(places.learn[order], begin)
        sequence, first = places.sequence[order], order[begin]
        before, symbol, share, chance = ([b[first] for b in places.before], *(x[first] for x in (places.symbol, places.share, places.chance)))
        begin = np.append(begin, len(order))
        every = np.diff(begin)
        a = _range(before, low)[0] if low else 0
        b = _range(before, high)[0] if high else len(symbol)
        cuts = a + _cut([x[a:b] for x in before], inside)
        often = 0 if going_on else len(common.value[0])
        rows = []
        for part, x, y in zip(parts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if x < y:
                rare = symbol[x:y] >= often
                rows.append((part, packed(
                    *(c[x:y] for c in before), symbol[x:y], n[x:y], every[x:y], sequence[begin[x] : begin[y]],
                    share[x:y][rare], chance[x:y][rare],
                )))
        if rows:
            yield _table("part:i chunk:l body:b", [r[0] for r in rows], [chunk] * len(rows), [r[1] for r in rows])

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        chunks, bodies = table.column("chunk").to_pylist(), table.column("body").to_pylist()
        mine = {c: divided[c] for c in plan.near(part)}
        known, told, tuples, bags = {}, [], [], []
        for chunk, body in zip(chunks, bodies, strict=True):
            if chunk is None:
                told.append(unpacked(body))
                continue
            *rows, every, sequence, share, chance = unpacked(body)
            # Half the memory, as long as there are not billions of words.
            rows = [r.astype(np.uint32) if r.max(initial=0) < 1 << 32 and i <= depth else r for i, r in enumerate(rows)]
            symbol = rows[depth]
            shares, chances = np.empty(len(symbol)), np.empty(len(symbol))
            often = np.zeros(len(symbol), bool) if going_on else symbol < len(common.value[0])
            for x, all_, rare in ((shares, common.value[0], share), (chances, common.value[1], chance)):
                x[often], x[~often] = all_[symbol[often]], rare
            tuples.append([*rows, shares, chances])
            bags.append((chunk, every, sequence))
        if not tuples:
            return _table("chunk:l sums:b on:b", [], [], [])
        if told:
            context, symbol, n = (np.concatenate(x) for x in zip(*told))
            order = np.lexsort((symbol, context))
            context, symbol, n = context[order], symbol[order], n[order]
            for i in np.unique(context).tolist():
                a, b = np.searchsorted(context, [i, i + 1])
                known[names[i]] = (symbol[a:b], n[a:b])
        *before, symbol, n, share, chance = (np.concatenate(x) for x in zip(*tuples))
        del tuples
        added, live, share, chance = _subtrees(before, symbol, n, share, chance, start, mine, known)
        out, at = [], 0
        for chunk, every, sequence in bags:
            sums = np.bincount(sequence, np.repeat(added[at : at + len(every)], every))
            of = np.flatnonzero(sums)
            a, b = np.searchsorted(live, [at, at + len(every)])
            rows = live[a:b]
            on = packed(*(x[rows] for x in before), symbol[rows], share[a:b], chance[a:b]) if a < b else None
            out.append((chunk, packed(of, sums[of]), on))
            at += len(every)
        return _table("chunk:l sums:b on:b", *zip(*out))

    def merge(table: pa.Table) -> pa.Table:
        found = [unpacked(b) for b in table.column("sums").to_pylist()]
        of, sums = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        sums = np.bincount(of, sums)
        on = [unpacked(b) for b in table.column("on").to_pylist() if b is not None]
        of = np.flatnonzero(sums)
        return _table(
            "chunk:l sums:b on:b", [table.column("chunk")[0].as_py()], [packed(of, sums[of])],
            [packed(*(np.concatenate(x) for x in zip(*on))) if on else None],
        )

    dealt = _mapped(source, ("chunk", "body"), "part int, chunk long, body binary", deal)
    if totals is not None:
        some = totals.where(F.col("part").between(parts.start, parts.stop - 1))
        dealt = dealt.union(some.select("part", F.lit(None).cast("long").alias("chunk"), "body"))
    done = dealt.groupBy("part").applyInArrow(work, "chunk long, sums binary, on binary")
    return done.groupBy("chunk").applyInArrow(merge, "chunk long, sums binary, on binary")


def _further(chunks: DataFrame, alive: DataFrame, depth: int, common: Broadcast) -> DataFrame:
    """(chunk, body, places): the places whose context of `depth` symbols is retained, with twice as many."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        on = [unpacked(b) for b in right.column("on").to_pylist()]
        for chunk, body in zip(left.column("chunk").to_pylist(), left.column("body").to_pylist(), strict=True) if on else ():
            *wanted, share, chance = (np.concatenate(x) for x in zip(*on))
            firsts = np.unique(wanted[0])
            near = lambda last: np.isin(last, firsts)
            places = _places(body, depth, common.value, wanted=near)
            # Few are left by a hash, which are then compared.
            hashes = np.unique(_hash(*wanted))
            hash_ = _hash(*places.before, places.symbol)
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, hash_), len(hashes) - 1)] == hash_)
            places = _places(body, 2 * depth, common.value, wanted=near, only=at)
            size = len(places.symbol)
            rank = _ranks(*(np.concatenate(x) for x in zip([*places.before[:depth], places.symbol], wanted, strict=True)))
            asked = np.full(int(rank.max(initial=-1)) + 1, -1)
            asked[rank[size:]] = np.arange(len(rank) - size)
            of = np.where(places.before[depth] > 0, asked[rank[:size]], -1)
            at = np.flatnonzero(of >= 0)
            of = of[at]
            if len(of):
                body = packed(*(b[at] for b in places.before), *(x[at] for x in (places.symbol, places.sequence, places.learn)), share[of], chance[of])
                rows.append((chunk, body, len(of)))
        return _table("chunk:l body:b places:l", *(zip(*rows) if rows else ([], [], [])))

    return chunks.select("chunk", "body").groupBy("chunk").cogroup(alive.groupBy("chunk")).applyInArrow(
        find, "chunk long, body binary, places long"
    )


def _with_sums(chunks: DataFrame, tables: list[DataFrame], schema: str, each: Callable) -> DataFrame:
    """`each(row of chunks, what its sequences gain)` gives a table."""
    sums = None
    for t in tables:
        sums = t.select("chunk", "sums") if sums is None else sums.union(t.select("chunk", "sums"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        more = np.zeros(row["size"].as_py())
        for of, gained in map(unpacked, right.column("sums").to_pylist()):
            more[of] += gained
        return each(row, more)

    return chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(run, schema)


def _list(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """Words one after the other, and their lengths."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    return pc.binary_join(whole, b"")[0].as_py(), lengths


def _listed(joined: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(joined.astype(np.uint8))])


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, ids, size, learned, body, words, different): texts as codes of a chunk's words, which are lower-cased,
    A to Z only; with the words, how often they are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", TEXT_BYTES):
            size = batch.num_rows
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
            flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
            full = pc.greater(pc.binary_length(flat), 0)
            words = flat.filter(full).dictionary_encode()
            of = of[full.to_numpy(zero_copy_only=False)]
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            learn = ~batch.column("held").to_numpy(zero_copy_only=False)
            joined, lengths = _list(words.dictionary.cast(pa.binary()))
            counts = np.bincount(codes[learn[of]], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), batch.column("id")),
                    pa.array([size], pa.int64()), pa.array([int(learn.sum())], pa.int64()),
                    pa.array([packed(codes, np.bincount(of, minlength=size), learn.astype(np.int64))], pa.binary()),
                    pa.array([packed(np.frombuffer(joined, np.uint8), lengths, counts)], pa.binary()), pa.array([len(lengths)], pa.int64()),
                ],
                names=["chunk", "ids", "size", "learned", "body", "words", "different"],
            )
            number += 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held", "text").mapInArrow(
        run, f"chunk long, ids array<{kind}>, size long, learned long, body binary, words binary, different long"
    )


def _words(chunks: DataFrame, ends: int) -> DataFrame:
    """(chunk, size, v, n, words, asked, letters, places, body): all words, each in one of many rows, as sequences of
    letters, learned from where they are learned; the empty word is a text's end. `asked`: where chunks have them."""
    parts = max(1, math.ceil((chunks.agg(F.sum("different")).first()[0] or 0) / WORDS))
    session = chunks.sparkSession

    def deal(chunk: int, words: bytes):
        joined, lengths, counts = unpacked(words)
        words, whole, ends = _listed(joined, lengths), joined.astype(np.uint8).tobytes(), np.cumsum(lengths)
        each_word = (whole[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True))
        part = np.fromiter(map(xxhash.xxh3_64_intdigest, each_word), np.uint64, len(lengths)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        joined, lengths = _list(words.take(pa.array(order)))
        joined, ends, counts = np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(lengths)]), counts[order]
        rows = [
            (i, packed(joined[ends[a] : ends[b]], lengths[a:b], counts[a:b], order[a:b]))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b
        ]
        yield _table("part:i chunk:l words:b", [r[0] for r in rows], [chunk] * len(rows), [r[1] for r in rows])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy())
        chunks = table.column("chunk").to_numpy()[order]
        found = [unpacked(table.column("words")[int(i)].as_py()) for i in order]
        every = pa.concat_arrays([_listed(f[0], f[1]) for f in found]).dictionary_encode()
        of = every.indices.to_numpy().astype(np.int64)
        c = np.bincount(of, np.concatenate([f[2] for f in found])).astype(np.int64)
        joined, lengths = _list(every.dictionary)
        codes = np.frombuffer(joined, np.uint8).astype(np.int64) + LETTER
        learn = c > 0
        letters = np.bincount(codes[np.repeat(learn, lengths)], minlength=LETTER + 256)
        letters[END] = learn.sum()
        body = _body(codes, lengths, learn.astype(np.int64), np.arange(LETTER + 256), np.zeros(0), np.zeros(0))
        asked = packed(chunks + 1, np.array([len(f[1]) for f in found]), np.concatenate([f[3] for f in found]), of)
        return pa.table(
            [
                *(pa.array([x], pa.int64()) for x in (key[0].as_py(), len(c), int(learn.sum()), int(c.sum()), len(codes) + len(c))),
                *(pa.array([x], pa.binary()) for x in (packed(c), asked, body)), pa.array([letters], pa.list_(pa.int64())),
            ],
            names=["chunk", "size", "v", "n", "places", "counts", "asked", "body", "letters"],
        )

    # The empty word is no chunk's own.
    none = np.zeros(1, np.int64)
    end = [(0, -1, packed(none[:0], none, np.array([ends]), none))]
    kinds = "part int, chunk long, words binary"
    dealt = _mapped(chunks, ("chunk", "words"), kinds, deal).union(session.createDataFrame(end, kinds))
    return dealt.groupBy("part").applyInArrow(
        gather, "chunk long, size long, v long, n long, places long, counts binary, asked binary, body binary, letters array<long>"
    )


def _spelled(scratch: _Scratch, words: DataFrame) -> tuple[list[DataFrame], np.ndarray]:
    """What letters before add to each word's log10 probability, and those of single letters."""
    found = words.select(F.posexplode("letters").alias("symbol", "n")).groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LETTER + 256)
    for r in found:
        counts[r.symbol] = r.n
    chance = (counts + 1) / (counts.sum() + SYMBOLS)
    common = words.sparkSession.sparkContext.broadcast((counts / max(1, counts.sum()), chance, 1))
    places = words.agg(F.sum("places")).first()[0]
    return _walk(scratch, words.select("chunk", "body"), LETTER_REACH, places, common, "letters"), np.log10(chance)


def score(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", training: Column | None = None,
) -> DataFrame:
    """For each document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Tokens are the lower-cased words and one end. `training` says which rows to learn from (default: those
    whose id is not held out). Defined cases: a null or empty text is its end alone; rows without id are for
    training; repeated rows count as often as they stand there and each gets its answer; without any training
    row every token is unknown and base_score is the limit for an empty vocabulary; an empty table gives no row.
    """
    out = held_out(F.col(id_column)) if training is None else ~F.coalesce(training, F.lit(False))
    rows = docs.select(
        F.col(id_column).alias("id"), out.alias("held"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    session, kind = docs.sparkSession, rows.schema["id"].dataType.simpleString()
    scratch = _Scratch(session)
    chunks = scratch.written(_chunks(rows), "chunks")
    ends = chunks.agg(F.sum("learned")).first()[0] or 0
    words = scratch.written(_words(chunks, ends), "words")
    v, n_train = words.agg(F.sum("v"), F.sum("n")).first()

    def counted(part: int, counts: bytes, body: bytes):
        c, lengths = unpacked(counts)[0], unpacked(body)[1]
        at = np.flatnonzero((c > n_train / FREQUENT) & (lengths > 0))
        yield _table("c:l part:l at:l", c[at], np.full(len(at), part), at)

    # The most frequent have the smallest numbers, which take the fewest bytes.
    met = _mapped(words, ("chunk", "counts", "body"), "c long, part long, at long", counted)
    frequent = sorted((-r.c, r.part, r.at) for r in met.toLocalIterator())
    often = LETTER + len(frequent)
    found = np.array(frequent, np.int64).reshape(-1, 3)
    by_part = {i: (found[found[:, 1] == i, 2], np.flatnonzero(found[:, 1] == i) + LETTER) for i in np.unique(found[:, 1]).tolist()}
    offsets, at = {}, often
    for r in words.select("chunk", "size").collect():
        offsets[r.chunk] = at
        at += r.size
    given = session.sparkContext.broadcast((by_part, offsets))
    tables, alone = _spelled(scratch, words)
    # A new word has the discounts of all others, and one more, to share by its letters.
    left, all_ = DISCOUNT * v + 1, n_train + 1

    def known_words(row: dict, more: np.ndarray) -> pa.Table:
        codes, lengths, *_ = unpacked(row["body"].as_py())
        sequence = np.repeat(np.arange(len(lengths)), lengths)
        letters = more + alone[END] + np.bincount(sequence, alone[codes], len(lengths))
        c, part = unpacked(row["counts"].as_py())[0], row["chunk"].as_py()
        p = np.where(c > 0, np.log10((np.maximum(c, 1) - DISCOUNT + left * 10.0**letters) / all_), letters + math.log10(left / all_))
        numbers = np.arange(len(c)) + given.value[1][part]
        chosen, small = given.value[0].get(part, ([], []))
        numbers[chosen] = small
        numbers[lengths == 0] = END
        return _table("known:b asked:b", [packed(numbers, c, p)], [row["asked"].as_py()])

    known = scratch.written(
        _with_sums(words.select("chunk", "size", "counts", "asked", "body"), tables, "known binary, asked binary", known_words), "known"
    )
    scratch.done(words, *tables)

    def small(known: bytes):
        numbers, c, p = unpacked(known)
        at = np.flatnonzero(numbers < often)
        yield _table("number:l c:l p:f", numbers[at], c[at], p[at])

    c_often, p_often = np.zeros(often), np.full(often, -np.inf)
    for r in _mapped(known, ("known",), "number long, c long, p double", small).toLocalIterator():
        c_often[r.number], p_often[r.number] = r.c, r.p
    share = session.sparkContext.broadcast((c_often / max(1, n_train), 10.0**p_often, max(1, n_train)))
    plain = session.sparkContext.broadcast((c_often, p_often))

    def tell(known: bytes, asked: bytes):
        numbers, c, p = unpacked(known)
        whose, sizes, places, of = unpacked(asked)
        ends = np.cumsum(sizes)
        rows = []
        for chunk, a, b in zip((whose - 1).tolist(), ends - sizes, ends, strict=True):
            if chunk >= 0:
                rare = of[a:b][numbers[of[a:b]] >= often]
                rows.append((chunk, packed(places[a:b], numbers[of[a:b]], c[rare], p[rare])))
        yield _table("of:l told:b", [r[0] for r in rows], [r[1] for r in rows])

    def numbered(left_: pa.Table, right: pa.Table) -> pa.Table:
        codes, lengths, learn = unpacked(left_.column("body")[0].as_py())
        told = [unpacked(b) for b in right.column("told").to_pylist()] or [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)]]
        places, numbers, c, p = (np.concatenate(x) for x in zip(*told))
        order = np.argsort(numbers)
        code = np.empty(len(order), np.int64)
        code[places[order]] = np.arange(len(order)) + LETTER
        rare = np.argsort(numbers[numbers >= often])
        body = _body(code[codes], lengths, learn, np.concatenate([np.arange(LETTER), numbers[order]]), c[rare], p[rare])
        return pa.table(
            [
                *(left_.column(x).combine_chunks() for x in ("chunk", "ids", "size")), pa.array([len(codes) + len(lengths)], pa.int64()),
                pa.array([body], pa.binary()),
            ],
            names=["chunk", "ids", "size", "places", "body"],
        )

    told = _mapped(known, ("known", "asked"), "of long, told binary", tell)
    coded = scratch.written(
        chunks.select("chunk", "ids", "size", "body").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(
            numbered, f"chunk long, ids array<{kind}>, size long, places long, body binary"
        ),
        "coded",
    )
    scratch.done(chunks, known)
    places = coded.agg(F.sum("places")).first()[0] or 0
    tables = _walk(scratch, coded.select("chunk", "body"), REACH, places, share, "texts")
    norm = math.log10(n_train + 0.1 * (v + 1))
    end_base, end_known = math.log10(ends + 0.1), int(ends > 0)

    def answers(row: dict, more: np.ndarray) -> pa.Table:
        codes, lengths, learn, numbers, *rare = unpacked(row["body"].as_py())
        c, p = (np.concatenate([a[numbers[numbers < often]], b]) for a, b in zip(plain.value, rare, strict=True))
        sequence = np.repeat(np.arange(len(lengths)), lengths)
        total = lambda x: np.bincount(sequence, x[codes], len(lengths))
        tokens = lengths + 1
        return pa.table(
            [
                row["ids"].values, pa.array(learn == 0), pa.array(tokens, pa.int64()), pa.array((total(c > 0) + end_known).astype(np.int64)),
                pa.array(np.full(len(tokens), n_train), pa.int64()), pa.array(total(np.log10(c + 0.1)) + end_base - tokens * norm),
                pa.array(total(p) + plain.value[1][END] + more),
            ],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    scores = _with_sums(
        coded.select("chunk", "ids", "size", "body"), tables,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", answers,
    )
    return scores.withColumnRenamed("id", id_column)
