"""Personal data by candidate gradient boosting.

Method. Strict patterns with checks (the base) give spans that are always kept. High-recall generators propose
further, overlapping spans: number runs and their parts, also what base spans leave of a run, with or without a
plus sign, as phone, card or address, and mail
addresses whose sign is spelled out. Only those that pass the check of their kind are ever chosen; which of them
is what boosted trees judge by format and context. They learn from all candidates of the whole corpus, copies once.
True are base spans, whose marks (plus sign, @) are no feature, and signed phones without their country's code. False are candidates
that fail the check, those that pass it but follow a word of other numbers (OTHER) or begin like a date, and
broken base spans: the same number after such a word, without its separators and context, or turned into a date.
Whole patterns (shape and context word) are held out, and on them each kind's probabilities are calibrated by a
logistic curve that few examples leave near the identity; a span is added at a calibrated probability of PRECISION.
Chosen spans are the most probable that overlap no other.

Scale. Two narrow passes over the documents. Candidates are counted by their features; each level of a tree, and
the calibration, is a pass over those counts, of which only sums of a bounded number reach the driver. The model goes
out with the job. All patterns are linear in the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.boosting import Boosted, feature_rows, fit, fit_table
from packwright.llm.common import slices, text_or_empty, with_columns, written

KINDS = ("email", "ip", "card", "phone")
#: Share of the candidates that is held out for the thresholds; ranges of their patterns' hashes that are weighed.
HELD_OUT, RANGES = 0.3, 4_096
#: Steps of the log odds in which held-out candidates are counted.
STEPS = 100
#: Labelled candidates of a sample, where one is asked for.
SAMPLE = 20_000
#: Calibrated probability asked of spans beyond the base.
PRECISION = 0.99
#: Strata of the sample: base spans, candidates that fail their check, candidates that pass it and are other numbers.
TRUE, FAILING, MISTAKEN = 0, 1, 2
CONTEXT = 24
#: Digits of the longest card: a part of a number run has no more.
MOST_DIGITS = 19

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from any other, so later starts are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])+")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words that speak for a kind when they stand before a span.
_CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"), "phone": ("tel", "phone", "call", "fax", "mobil"),
}
#: Words that name other numbers.
OTHER = (
    "account", "article", "batch", "id", "invoice", "isbn", "item", "order", "parcel", "part", "ref", "reference",
    "release", "serial", "sku", "ticket", "tracking", "version",
)
_OTHER = re.compile(rf"\b(?:{'|'.join(OTHER)})\b")
_DATE = re.compile(r"[+(]?(?:19|20)[0-9]{2}[-./ ]?(?:0[1-9]|1[0-2])[-./ ]?(?:[0-2][0-9]|3[01])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, span: str) -> bool:
    """The check of a kind, for text of its form."""
    digits = "".join(_DIGIT.findall(span))
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return bool(re.fullmatch(r"[^@ ]+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", span))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @, back over the name and on over the domain, so that a
    long run without @ is read once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; code points, end exclusive."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            if k == 1 and "." not in text or k == 3 and "+" not in text:
                continue
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m.group())]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """What the generators propose, overlaps included; `base`: the text's base spans, if known."""
    out = []
    if "@" in text or "at)" in text or "at]" in text:
        out += [(m.start(), 0, m.end()) for m in _spelt(text)]
    if _DIGIT.search(text):
        # What base spans leave of a run is a run, too; the whole is proposed as well, for the trees to learn from.
        taken = [(s, e) for s, _, e in (base_spans(text) if base is None else base)]
        for m in _NUMBERS.finditer(text):
            if text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum():
                continue  # part of a longer name or key
            found = dict.fromkeys(_parts(text, m.start(), m.end()))
            at = m.start()
            for s, e in [*(t for t in taken if t[0] < m.end() and m.start() < t[1]), (m.end(), m.end())]:
                if (at, s) != (m.start(), m.end()) and at < s:
                    found |= dict.fromkeys(_parts(text, at, s))
                at = max(at, e)
            out += found
    return out


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """The whole run, and every part that begins and ends with a group of digits and has MOST_DIGITS or fewer:
    at most MOST_DIGITS from each group, so this is linear."""
    groups = [(m.start(), m.end()) for m in re.compile(r"[0-9]+").finditer(text, start, end)]
    if not groups:
        return

    def kinds(at: int, to: int, digits: int) -> Iterator[tuple[int, int, int]]:
        sign = at - (at > start and text[at - 1] in "+(")
        if digits >= 7:
            yield sign, 3, to
        if digits >= 12:
            yield at, 2, to
        if digits >= 4 and text.count(".", at, to) == 3:
            yield at, 1, to

    yield from kinds(groups[0][0], groups[-1][1], sum(e - s for s, e in groups))
    for i, (at, _) in enumerate(groups):
        digits = 0
        for s, to in groups[i : i + MOST_DIGITS]:
            digits += to - s
            if digits > MOST_DIGITS:
                break
            yield from kinds(at, to, digits)


def _spelt(text: str) -> Iterator[re.Match]:
    """Addresses with a spelt-out sign, looked for around each sign only."""
    end = 0
    for sign in re.finditer(r"\(at\)|\[at\]|@", text):
        start = sign.start()
        if start > end and text[start - 1] == " ":
            start -= 1
        while start > max(end, sign.start() - 65) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if sign.start() >= end and (m := _SPELT.match(text, start)):
            yield m
            end = m.end()


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span, without the marks by which the base finds it."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + 1]
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    tail = span.rsplit(".", 1)[-1] if "." in span else ""
    return [
        float(kind), float(end - start), float(sum(sizes)), float(len(groups)),
        float(max(sizes)), float(min(sizes)), float(sizes[0]), float(span.count(".")), float(span.count(" ")), float(span.count("-")),
        float(span.count("(")), float(tail.isalpha()), float(len(tail)), float(sum(c.isalpha() for c in span)),
        float(bool(before) and before[-1].isalnum()), float(after.isalnum()),
        float(any(c in before for c in _CUES[KINDS[kind]])),
        float(any(c in before for k, cues in _CUES.items() if k != KINDS[kind] for c in cues)),
        float(bool(_OTHER.search(before))), float(bool(_DATE.match(span))),
    ]


def passes(text: str, kind: int, start: int, end: int) -> bool:
    return valid(KINDS[kind], text[start:end].lstrip("+("))


def broken(kind: int, span: str, draw: int) -> tuple[str, int, int] | None:
    """A base span made into another number: (text, start, end), by one of a few ways that `draw` picks."""
    core, word = span.lstrip("+("), OTHER[draw // 4 % len(OTHER)]
    digits = "".join(_DIGIT.findall(core))
    if kind == 0:
        return None
    before, way = f"{word} ", draw % 4 if kind == 3 else 0
    if way == 1:
        core = digits
    elif way == 2:
        before, core = "", digits
    elif way == 3:
        before, core = "", f"20{digits[:2]}-0{1 + draw % 9}-1{digits[2]} {digits[3:]}"
    text = f"{before}{core} "
    return (text, len(before), len(text) - 1) if passes(text, kind, len(before), len(text) - 1) else None


def at_home(text: str, start: int, end: int, bare: bool) -> tuple[str, int, int] | None:
    """A signed phone as it is written without its country's code, in its context or bare of it: (text, start, end),
    if enough digits are left."""
    groups = list(re.compile(r"[0-9]+").finditer(text, start, end))
    if len(groups) < 2:
        return None
    at = groups[1].start() - (text[groups[1].start() - 1] == "(")
    before = " " if bare else text[max(0, start - CONTEXT) : start]
    changed, place = before + text[at:end] + text[end : end + 1], (len(before), len(before) + end - at)
    return (changed, *place) if passes(changed, 3, *place) else None


def _label(text: str, kind: int, start: int, end: int, base: set[tuple[int, int, int]]) -> int | None:
    """The stratum of a candidate; None if nothing tells what it is."""
    if (start, kind, end) in base:
        return TRUE
    if not passes(text, kind, start, end):
        return FAILING
    if any(start < e and s < end for s, _, e in base):
        return None
    before = text[max(0, start - CONTEXT) : start].lower()
    return MISTAKEN if _OTHER.search(before) or _DATE.match(text, start, end) else None


def _labelled(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of at most `sample` candidates of each label; see `_sampled`."""
    x, y, weights, _ = _sampled(docs, sample)
    return x, y, weights


def _candidates(docs: DataFrame) -> DataFrame:
    """(h, g, x, s): hash, hash of the pattern, features and stratum of every labelled candidate, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], []]

            def add(h: int, g: int, text: str, kind: int, start: int, end: int, stratum: int, rows: list[list] = rows) -> None:
                rows[0].append(h >> 1)
                rows[1].append(g >> 1)
                rows[2].append(features(text, kind, start, end))
                rows[3].append(stratum)

            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                base = set(spans)
                for start, kind, end in dict.fromkeys([*candidates(text, spans), *spans]):
                    if (stratum := _label(text, kind, start, end, base)) is None:
                        continue
                    key = f"{start}:{kind}:{end}:{text[start:end]}{text[max(0, start - 40):start]}"
                    h = xxhash.xxh3_64_intdigest(key)
                    # What is made of a span is of its pattern, so that both are learned from or both held out.
                    word = _OTHER.findall(text[max(0, start - CONTEXT) : start].lower())[-1:]
                    g = xxhash.xxh3_64_intdigest(f"{kind}:{_DIGIT.sub('9', text[start:end])}:{word}")
                    add(h, g, text, kind, start, end, stratum)
                    if stratum != TRUE:
                        continue
                    forms = [text[start:end]]
                    if kind == 3 and (home := at_home(text, start, end, bool(h >> 4 & 1))):
                        changed, s, e = home
                        add(xxhash.xxh3_64_intdigest(f"home {key}"), g, changed, kind, s, e, TRUE)
                        forms.append(changed[s:e])
                    for i, form in enumerate(forms):
                        if other := broken(kind, form, h >> 8):
                            add(xxhash.xxh3_64_intdigest(f"broken {i} {key}"), g, other[0], kind, *other[1:], MISTAKEN)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.float64())), pa.array(rows[3], pa.int32())],
                names=["h", "g", "x", "s"],
            )

    # Equal candidates (copies of a document) count once, so that a large group of copies is one example.
    found = docs.mapInArrow(run, "h long, g long, x array<double>, s int").groupBy("h").agg(
        *[F.first(c).alias(c) for c in ("g", "x", "s")]
    )
    return written(found, "candidates")


def _sampled(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, weights and patterns of labelled candidates: those of smallest hash of each kind and label,
    half of the false ones such that pass their check, if there are as many. A weight is how many in the corpus one
    stands for."""
    rows = _candidates(docs)
    kind = F.col("x")[0].cast("int")
    counts = {(r.k, r.s): r.n for r in rows.groupBy(kind.alias("k"), "s").agg(F.count("*").alias("n")).collect()}
    most = max(1, sample // (2 * len(KINDS)))
    # Hashes are even, so this bound on them lets a few more than `most` through: no group has to be ranked.
    share = (most + 6 * most**0.5 + 20) * 2.0**63
    under = F.lit(False)
    for (k, s), n in counts.items():
        under = under | ((kind == k) & (F.col("s") == s) & (F.col("h") < F.lit(int(min(2**63 - 1, share / n)))))
    got = sorted(rows.where(under).collect(), key=lambda r: (r.x[0], r.s, r.h))
    strata = {key: [r for r in got if (int(r.x[0]), r.s) == key] for key in sorted(counts)}
    kept, weights = [], []
    for (k, s), part in strata.items():
        room = most
        if s != TRUE:
            other = len(strata.get((k, FAILING + MISTAKEN - s), ()))
            room = max(most - other, most // 2 if s == MISTAKEN else most - most // 2)
        part = part[:room]
        kept += [(r.x, s == TRUE, r.g) for r in part]
        weights += [counts[k, s] / len(part)] * len(part) if part else []
    return np.array([r[0] for r in kept]), np.array([r[1] for r in kept], float), np.array(weights), np.array([r[2] for r in kept])


def _held_out(x: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Which examples are held out: of each kind whole patterns by their hash, while they are HELD_OUT of it or less."""
    held = np.zeros(len(x), bool)
    for k in range(len(KINDS)):
        part = np.flatnonzero(x[:, 0] == k)
        _, place, sizes = np.unique(patterns[part], return_inverse=True, return_counts=True)
        if len(part):
            held[part] = (np.cumsum(sizes) <= HELD_OUT * len(part))[place]
    return held


def _curve(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(a, b) of the calibrated log odds a * z + b: logistic loss, weighted by how many an example stands for, plus a
    pull to (1, 0)."""
    w = np.array([1.0, 0.0])
    if len(y):
        f, v = np.stack([z, np.ones(len(z))], axis=1), weights
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            slope = f.T @ (v * (p - y)) + (w - [1.0, 0.0])
            bend = (f * (v * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ f + np.eye(2)
            step = np.linalg.solve(bend, slope)
            w = w - step * min(1.0, 1.0 / max(1e-9, float(np.abs(step).max())))
    return max(float(w[0]), 0.05), float(w[1])


def learn(docs: DataFrame, sample: int | None = None) -> tuple[Boosted, list[float]]:
    """The trees and one threshold per kind, from a frame with a string column `text` without nulls; from every
    candidate, or on wish from a sample."""
    if sample is None:
        return _learned(_candidates(docs))
    x, y, weights, patterns = _sampled(docs, sample)
    if not len(y):
        return Boosted(), [PRECISION] * len(KINDS)
    held = _held_out(x, patterns)
    model = fit(x[~held], y[~held])
    z, own = model.log_odds(x), [held & (x[:, 0] == k) for k in range(len(KINDS))]
    return model, [_limit(z[o], y[o], weights[o] / weights[o].mean() if o.any() else weights[o]) for o in own]


def _learned(candidates: DataFrame) -> tuple[Boosted, list[float]]:
    """The trees and thresholds from all rows of `_candidates`."""
    counted = counted_features(candidates)
    if counted.isEmpty():
        return Boosted(), [PRECISION] * len(KINDS)
    model = fit_table(counted.where("not held"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = feature_rows(batch)
                z = np.rint(np.clip(model.log_odds(x), -30, 30) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:, 0].astype(np.int64)), pa.array(z), batch.column("y"), batch.column("n")], names=["k", "z", "y", "n"]
                )

    held = counted.where("held").select("x", "y", "n").mapInArrow(placed, "k long, z long, y int, n long")
    found = held.groupBy("k", "z", "y").agg(F.sum("n").alias("n")).orderBy("k", "z", "y").collect()
    limits = []
    for k in range(len(KINDS)):
        own = np.array([(r.z / STEPS, r.y, r.n) for r in found if r.k == k], float).reshape(-1, 3)
        limits.append(_limit(*own.T))
    return model, limits


def counted_features(candidates: DataFrame) -> DataFrame:
    """(x, y, held, n): how many candidates have these features and label. Of each kind whole patterns are held out,
    by ranges of their hashes, while they are HELD_OUT of it or less."""
    kind, width = F.col("x")[0].cast("int"), 2**63 // RANGES
    ranged = candidates.select("x", (F.col("s") == TRUE).cast("int").alias("y"), kind.alias("k"), F.floor(F.col("g") / F.lit(float(width))).cast("int").alias("r"))
    sizes: dict[int, list] = {k: [] for k in range(len(KINDS))}
    for row in ranged.groupBy("k", "r").agg(F.count("*").alias("n")).orderBy("k", "r").collect():
        sizes[row.k].append((row.r, row.n))
    held = F.lit(False)
    for k, parts in sizes.items():
        before, total = 0, sum(n for _, n in parts)
        for r, n in parts:
            before += n
            if before > HELD_OUT * total:
                held = held | ((F.col("k") == k) & (F.col("r") < r))
                break
    return written(ranged.groupBy("x", "y", held.alias("held")).agg(F.count("*").alias("n")), "features")


def _limit(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The probability of the trees at which the calibrated one is PRECISION."""
    a, b = _curve(np.clip(z, -30, 30), y, weights)
    wanted = float(np.log(PRECISION / (1 - PRECISION)))
    return max(0.5, float(1 / (1 + np.exp(-np.clip((wanted - b) / a, -30, 30)))))


def all_spans(text: str, model: Boosted, limits: list[float]) -> tuple[list, list]:
    """Base spans, and base with chosen spans, each sorted by start and kind."""
    base = base_spans(text)
    more = [
        (start, k, end) for start, k, end in candidates(text, base)
        if passes(text, k, start, end) and not any(start < e and s < end for s, _, e in base)
    ]
    if not more:
        return base, base
    p = model.probability(np.array([features(text, k, s, e) for s, k, e in more]))
    chosen = []
    for i in sorted(range(len(more)), key=lambda i: (-p[i], more[i])):
        s, k, e = more[i]
        if p[i] >= limits[k] and not any(s < f and b < e for b, _, f in chosen):
            chosen.append(more[i])
    return base, sorted(base + chosen)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_private(
    docs: DataFrame, text_column: str = "text", sample: int | None = None, id_column: str | None = None,
    redact: bool = True,
) -> DataFrame:
    """All columns of the documents as struct `row` (or `id_column` alone), with n_email, n_ip, n_card, n_phone
    (base spans), base_sha256, spans, n_added and, if wanted, `redacted`.

    Spans are `kind:start:end` in code points, joined by commas. Defined cases: a null or empty text has no
    span (redacted: a null stays null); repeated rows get the same spans; ids play no part; an empty table
    gives no row and learns nothing.
    """
    text = text_or_empty(text_column)
    model, limits = learn(docs.select(text.alias("text")), sample)
    row = F.struct("*") if id_column is None else F.struct(F.col(id_column))
    packed = docs.select(row.alias("row"), F.col(text_column).isNull().alias("none"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for batch in slices(batches, "text"):
            counts, digests, spans, added, texts = [], [], [], [], []
            for none, value in zip(batch.column("none").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, every = all_spans(value, model, limits)
                counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(name(base).encode()).hexdigest())
                spans.append(name(every))
                added.append(len(every) - len(base))
                if redact:
                    texts.append(None if none else redacted(value, every))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            more = {f"n_{k}": pa.array(n[:, i]) for i, k in enumerate(KINDS)}
            more |= {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(added, pa.int64())}
            if redact:
                more["redacted"] = pa.array(texts, pa.string())
            yield with_columns(batch.select(["row"]), more)

    kind = packed.schema["row"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    more = ", redacted string" if redact else ""
    return packed.mapInArrow(run, f"row {kind}, {counts}, base_sha256 string, spans string, n_added long{more}")
