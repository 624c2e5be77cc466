"""Each operator against plain Python on odd rows: nulls, empty and long texts, copies, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packwright.llm import (
    boosting, mixing, near_dedup, neighbours, packing, pii, quality_rules, substring_dedup, suffix_tree, token_counts, url_filter,
    word_tokens,
)

WORDS = [a + b for a in ("ka", "lo", "mi", "ré", "su", "The") for b in ("n", "rt", "x,", "öl", "")]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _rows():
    rng = random.Random(5)
    long = _text(rng, 20_000)
    passage = _text(rng, 60)
    base = _text(rng, 200).split(" ")
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (3, 50, 120, 199)]
    texts = [
        None, "", " \n\t", "a b", "A  b", "one", " ".join(base), " ".join(base).upper(), *near,
        long, long, _text(rng, 30) + " " + passage + " " + _text(rng, 30), passage + "\n" + _text(rng, 90),
        "x " * 80, "a b c " * 40, "mail joe.b@mail.example.com or +1 (415) 555-0100 now", "4111 1111 1111 1111 at 10.0.0.255, 300.1.1.1",
        "don't 'S’ ß İstanbul ﬁ e\u0301 <|endoftext|> ١٢ 中文", "line one\nline one\n\nline two\nline one",
    ]
    rows = [(i, t, "en" if i % 3 else None, "s%d" % (i % 2), "clash", False) for i, t in enumerate(texts)]
    return [*rows, (None, "no id here at all, but enough words to be kept by rules", "fr", None, "c", True), rows[6], rows[6]]


SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().split()


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_tokens.default_vocabulary())
    want = collections.Counter()
    for i, t, *_ in _rows():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(none).count() == 0


def test_two_fit_replaces_the_smallest():
    # Greedy: 6 + 3 leaves a gap of 1; 3 makes way for 2 + 2.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(12)}
        used = collections.Counter()
        for times, filling in packing.best_two_fit(counts, 64):
            assert sum(filling) <= 64
            for length in filling:
                used[length] += times
        assert used == counts


def _plain_spans(text):
    kinds = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            fine = (
                True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15,
            )[k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_private_spans(docs, none):
    got = pii.find_private(docs).collect()
    assert len(got) == len(_rows())
    for r in got:
        spans = _plain_spans(r.row.text or "")
        name = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(name.encode()).hexdigest()
        assert set(filter(None, name.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert (r.redacted is None) == (r.row.text is None)
    assert pii.find_private(none).count() == 0


def test_base_spans_fuzz():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- ()25b") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == _plain_spans(text), text
    long = "a" * 200_000 + "1" * 200_000
    assert pii.base_spans(long) == []


def test_trees_learn_a_mark(spark):
    rng = random.Random(3)
    rows = [(f"call +1 (415) 555-{rng.randint(1000, 9999)} today {rng.randint(10**6, 10**7)} x",) for _ in range(600)]
    model, limits = pii.learn(spark.createDataFrame(rows, "text string"))
    base, every = pii.all_spans("call (415) 555-1234 now", model, limits)
    assert base == [] and every in ([], [(5, 3, 19)])


def test_adjacent_numbers_are_added(spark):
    rng = random.Random(9)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(f"call +1-{number()} today or nr {rng.randint(10**5, 10**6 - 1)}-{rng.randint(0, 9)} x",) for _ in range(900)]
    model, limits = pii.learn(spark.createDataFrame(rows, "text string"))
    for text in ("call 555-123-4567 555-987-6543 x", "10.0.0.1 415-555-1234 x", "2024 415-555-1234 x"):
        assert {(m.start(), 3, m.end()) for m in re.finditer(r"[0-9]{3}-[0-9]{3}-[0-9]{4}", text)} <= set(pii.candidates(text)), text
    for text, n in (("call 555-123-4567 555-987-6543 x", 2), ("10.0.0.1 415-555-1234 x", 1)):
        base, every = pii.all_spans(text, model, limits)
        more = [x for x in every if x not in base]
        assert more and sum(len(re.findall("[0-9]", text[s:e])) for s, _, e in more) >= 10 * n, (text, every, limits)


def test_other_numbers_stay(spark):
    """Numbers that pass a phone's check but are none stay in the text; unsigned phones go."""
    rng = random.Random(12)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    rows = [(f"please call +1-{number()} or +44 {rng.randint(20, 99)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} x",) for _ in range(500)]
    rows += [(f"see order {rng.randint(10**9, 10**10)} and total {rng.randint(10**6, 10**8)} x",) for _ in range(300)]
    frame = spark.createDataFrame(rows, "text string")
    x, y, _ = pii._labelled(frame, pii.SAMPLE)
    assert all(len({(v, t) for v, t in zip(x[:, i], y, strict=True)}) > len(set(x[:, i])) for i in range(x.shape[1]))
    model, limits = pii.learn(frame)
    for text in ("order number 1234567890", "id 20240101123456", "ISBN 978-3-16-148410-0", "serial 12345678901"):
        assert pii.all_spans(text, model, limits) == ([], []), text
    for text in ("please call 415-555-1234 x", "call 1-415-555-1234 now"):
        base, every = pii.all_spans(text, model, limits)
        assert base == [] and [k for _, k, _ in every] == [3], (text, limits)


def test_rare_kinds_have_their_own_examples(spark):
    rng = random.Random(10)
    card = "4111 1111 1111 1111"
    rows = [(f"nr {rng.randint(10**6, 10**8)} x",) for _ in range(4000)]
    rows += [(f"paid {'abcdefgh'[i]} by card {card} x",) for i in range(8)]
    frame = spark.createDataFrame(rows, "text string")
    x, y, weights = pii._labelled(frame, 800)
    assert ((x[:, 0] == 2) & (y == 1)).sum() == 8
    phones = (x[:, 0] == 3) & (y == 0)
    assert phones.sum() == 100 and 2500 < weights[phones].sum() < 6000
    assert all(t <= 1 for t in pii.learn(frame, 800)[1])


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (920, []), (940, [0.0] * 16), (960, [float("nan")] * 16), (980, [1.0, None] * 8), (1000, [1.0]), (None, [1.0] * 16), rows[0]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, frame.where("vec_id % 20 = 0").select("vec_id")).collect()
    hit = total = 0
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 600, 20))
    for q, found in by.items():
        exact = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -exact)) if i != q][:20]
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - exact[i]) < 1e-9 for i, s in found)
        hit, total = hit + len({i for i, _ in found} & set(order)), total + 20
    assert hit / total >= 0.9
    assert neighbours.nearest(frame.where("false"), frame.select("vec_id")).count() == 0


def _recalls(spark, x, queries, k=20):
    """Share of the k largest scores found, per query; equal scores stand for each other."""
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(int(q),) for q in queries], "vec_id long")
    found = collections.defaultdict(list)
    for r in neighbours.nearest(frame, asked, k).collect():
        found[r.query_id].append(r.score)
    out = {}
    for q in queries:
        exact = np.delete(x @ x[q], q)
        out[q] = sum(s >= np.sort(exact)[-k] - 1e-9 for s in found[q]) / k
    return out


def test_neighbours_beside_many_copies_and_clusters(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 32))
    x[::3] = x[0]
    # Groups of ten near copies: fewer than k, so that the nearest tell nothing of the k-th.
    x[1:1501:3] = np.repeat(x[1:1501:30], 10, axis=0) + rng.normal(size=(500, 32)) / 100
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = _recalls(spark, x, [*range(0, 600, 20), *range(1, 1500, 51), *range(2, 6000, 120)])
    mean = lambda part: sum(part) / len(part)
    assert mean([r for q, r in got.items() if q % 3 == 0]) >= 0.95
    assert mean([r for q, r in got.items() if q % 3 == 1]) >= 0.9
    assert mean([r for q, r in got.items() if q % 3 == 2]) >= 0.9


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(_rows())
    assert all(not r.kept for r in got if not r.n_tokens)
    assert all(0 <= r.probability <= 1 for r in got)
    assert [r.n_tokens for r in got if r.row.doc_id == 3] == [2]
    assert mixing.mix(none).count() == 0


def test_raking_meets_its_targets(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 300), ("b", "x", "t", 400), ("b", "y", "t", 200)], "source string, lang string, topic string, tokens long")
    share = lambda *v: spark.createDataFrame(v, "value string, share double")
    out = mixing.raked(cells, {"source": share(("a", 1.0), ("b", 1.0)), "lang": share(("x", 0.4), ("y", 0.6))}, 0.3, 20).collect()
    for name, value, want in (("source", "a", 150), ("source", "b", 150), ("lang", "x", 120), ("lang", "y", 180)):
        assert abs(sum(r.weight for r in out if r[name] == value) - want) < 0.01


def test_edited_counts(docs, none):
    from packwright.llm.queries import three_edits
    from packwright.llm.word_tokens import WordIds, default_vocabulary
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary())
    size = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    trees = token_counts.build_trees(docs)
    for r in token_counts.apply_edits(trees, three_edits(F.col("text"))).collect():
        assert r.tokens_before == size(r.row.text or "")
        assert r.n_tokens == size(r.text)
    assert token_counts.apply_edits(token_counts.build_trees(none), three_edits(F.col("text"))).count() == 0
    two_steps = token_counts.apply_edits(trees, three_edits(F.col("text")))
    one_pass = token_counts.build_and_edit(docs, three_edits(F.coalesce("text", F.lit(""))))
    assert one_pass.columns == two_steps.columns
    assert sorted(map(str, one_pass.collect())) == sorted(map(str, two_steps.collect()))
    assert token_counts.build_and_edit(none, three_edits(F.col("text"))).count() == 0
    rng, ids = random.Random(4), WordIds()
    for _ in range(60):
        text = _text(rng, rng.randint(0, 300))
        tree = token_counts.TokenTree.build(token_counts.leaves_of(text, 20), ids)
        for _ in range(6):
            a, n = rng.randint(0, len(text) + 2), rng.randint(0, 60)
            new = rng.choice(["", " ", "new words here", "'s", "x" * 90])
            want = text[: min(a, len(text))] + new + text[max(min(a, len(text)), min(a + n, len(text))) :]
            text, _ = tree.edit(text, a, a + n, new, ids)
            assert text == want and tree.tokens == size(text) and tree.sums[1, 0] == len(text)


def test_quality_statistics_and_rules(spark, docs, none):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (12, 1, 0), (None, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge(docs, labels).collect():
        text = r.row.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = collections.Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
        )
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.where("false")).count() == len(_rows())


def test_rules_are_learned(spark):
    rng = random.Random(6)
    rows = [(i, _text(rng, 60) + (" ### | $$" * 6 if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    judged = [r for r in got if not r.base_failed]
    assert all(r.kept == (r.row.doc_id % 4 > 0) for r in judged)


def test_urls(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = [None, "", "no host", "http://example.com/en/a", "HTTP://WWW.Example.com/en/", "https://a.b.example.com/en", "x://net/es/1",
            "http://badnet/es/", "http://q.net/es/?x", "http://q.org/list/", "http://www.q.org/list?b", "http://q.org/other", "http://com", "a://b://c.net/es/"]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)] + [(3, urls[3], "x")], "page_id long, url string, verdict string")
    entries = url_filter.rule_entries(spark, rules).union(url_filter.listed_entries(pages.where("page_id = 9")))
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, entries).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fit = [(len(r), r, v) for v, r in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fit)[1:] if fit else (None, "block" if i in (9, 10) else "allow")
        assert got[i] == (host, path, rule, verdict), u
    assert url_filter.judge_urls(pages, entries.where("false")).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.where("false"), entries).count() == 0


def test_suffix_tree_scores(docs, none):
    rows = _rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts, ends = collections.Counter(), 0
    for i, t, *_ in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = suffix_tree.score(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        words = (texts[r.doc_id] or "").encode().lower().split()
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words) + 1, sum(w in counts for w in words) + 1, n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and -1e6 < r.score < 0
    assert suffix_tree.score(none).count() == 0


def _plain_scores(texts, training):
    """The suffix trees with dictionaries: log10 scores of all texts."""

    def grow(sequences, root):
        trees, d = [{(): root}], 0
        while True:
            d += 1
            found = collections.defaultdict(collections.Counter)
            for s in sequences:
                for i in range(d, len(s)):
                    if s[i - d + 1 : i] in trees[-1]:
                        found[s[i - d : i]][s[i]] += 1
            kept = {}
            for context, n in found.items():
                counts, chance = trees[-1][context[1:]][:2]
                total, above = sum(n.values()), sum(counts.values())
                gain = sum(k * math.log(k / total * above / counts[x]) for x, k in n.items())
                if total >= 2 and gain >= math.log(total) * len(n) / 2:
                    rest = len(n) / (total + len(n))
                    kept[context] = (n, {x: k / (total + len(n)) + rest * chance[x] for x, k in n.items()}, rest)
            if not kept:
                return trees
            trees.append(kept)

    def chance(trees, s, i, d, root):
        if d == 0:
            return root(s[i])
        if i < d or s[i - d : i] not in trees[d]:
            return chance(trees, s, i, d - 1, root)
        n, p, rest = trees[d][s[i - d : i]]
        return p[s[i]] if s[i] in p else rest * chance(trees, s, i, d - 1, root)

    split = [(t or "").encode().lower().split() for t in texts]
    counts, ends = collections.Counter(w for w, t in zip(split, training) if t for w in w), sum(training)
    whole = {**counts, b"": ends} if ends else dict(counts)
    of = lambda w: ("<", *w, ">")
    letters = collections.Counter(x for w in whole for x in of(w)[1:])
    size = sum(letters.values()) + 257
    first = lambda x: (letters[x] + 1) / size
    spell = grow([of(w) for w in whole], (letters, {x: first(x) for x in letters}))

    def alone(w):
        s = of(w)
        p = math.prod(chance(spell, s, i, len(spell) - 1, first) for i in range(1, len(s)))
        left = 0.75 * len(whole) + 1
        return (max(0, whole.get(w, 0) - 0.75) + left * p) / (sum(whole.values()) + 1)

    rows = [("<", *w, b"") for w in split]
    known = {w: alone(w) for w in {x for r in rows for x in r[1:]}}
    trees = grow([r for r, t in zip(rows, training) if t], (whole, known))
    return [sum(math.log10(chance(trees, r, i, len(trees) - 1, known.get)) for i in range(1, len(r))) for r in rows], len(trees) - 1


def _some_texts():
    rng = random.Random(4)
    words = ["ka", "kalo", "mi", "mire", "su", "su", "the", "ré", "x" * 12]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [" ".join(rng.choice(["ka x lo", "mi x su"]) for _ in range(20)) for _ in range(20)]
    return [*texts, *["su mi ka the new", "ka mi ré"] * 4, "", None, "never seen kami", "su su su su su su su", "su mi ka the new"]


def test_scores_equal_plain_ones(spark):
    texts = _some_texts()
    want, depth = _plain_scores(texts, [i % 5 > 0 for i in range(len(texts))])
    assert depth >= 2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_tree.score(frame, training=F.col("doc_id") % 5 > 0).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9), (r, want[r.doc_id])


def test_rare_words_and_pairs_keep_their_statistic(spark):
    rng = random.Random(8)
    # 60,000 other words: a pair seen twice is far below any share of the corpus.
    rows = [(" ".join("w%d" % rng.randrange(3000) for _ in range(60)),) for _ in range(1000)]
    rows += [("w1 zalpha zbeta w2",)] * 2 + [("w1 zgamma zdelta w2",)] * 2
    asked = [("zalpha zbeta",), ("zalpha zdelta",)]
    frame = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows + asked)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(frame, training=F.col("doc_id") < len(rows)).collect()}
    assert got[len(rows)] > got[len(rows) + 1] + 2


def test_next_word_depends_on_two(spark):
    # "x" alone tells nothing, the word before it all.
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ka x lo", "mi x su"]) for _ in range(20)) for _ in range(40)] + ["ka x lo", "ka x su"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score(frame, training=F.col("doc_id") < 40).collect()}
    assert got[40] > got[41] + 1


@pytest.mark.parametrize("part, reach, letters, frequent", [(40, 2, 3, 500_000), (150, 4, 2, 20), (10**6, 1, 1, 4)])
def test_scores_do_not_depend_on_how_places_are_dealt(spark, monkeypatch, part, reach, letters, frequent):
    texts = _some_texts()
    training = [i % 5 > 0 for i in range(len(texts))]
    want, _ = _plain_scores(texts, training)
    for name, value in {"PART": part, "REACH": reach, "LETTER_REACH": letters, "FREQUENT": frequent}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    divided, walked = [], suffix_tree._divided
    monkeypatch.setattr(suffix_tree, "_divided", lambda *a: divided.append(walked(*a)) or divided[-1])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_tree.score(frame, training=F.col("doc_id") % 5 > 0).collect()
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9), (r, want[r.doc_id])
    # With small ranges some retained contexts lie in several of them.
    assert any(kept for contexts, _ in divided for kept, *_ in contexts.values()) == (part <= 150)


def test_scores_leave_less_than_their_input_behind(spark):
    def held():
        root = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
        return sum(p.stat().st_size for p in root.rglob("*") if p.is_file())

    rng = random.Random(9)
    texts = [" ".join("w%d" % min(rng.randrange(1, 3000), rng.randrange(1, 3000)) for _ in range(300)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = held()
    assert suffix_tree.score(frame).count() == len(texts)
    assert held() - before < sum(map(len, texts))


def test_near_duplicates(docs, none):
    rows, sets = _rows(), {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if sets[a] and None not in (a, b) and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    got = near_dedup.near_duplicates(docs, shingle_words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r.row.doc_id
        assert (r.n_shingles, r.component_id) == (len(sets[i]), root[i])
        assert r.kept == (root[i] is None or i == root[i])
    assert near_dedup.near_duplicates(none).count() == 0


def test_chains_of_near_copies(spark):
    """A large family in which most pairs are no links: components must still be found."""
    rng = random.Random(9)
    text = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(120)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(len(text))] = f"w{rng.randint(0, 10**6)}"
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    got = near_dedup.near_duplicate_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root


def test_repeated_passages(docs, none):
    rows, count = _rows(), collections.Counter()
    for _, t, *_ in rows:
        w = _words(t)
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for i, t, *_ in rows:
        w = _words(t)
        covered = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in covered)
        want[i, len(w), len(covered), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.without_repeats(docs).collect()
    assert collections.Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substring_dedup.without_repeats(none).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("n_words", "kept").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (16, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        at = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "private_data", "mixing", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length > 2048").count() == 0


def test_one_row_of_each_group_stays(spark, docs, none):
    import corpus_pipeline

    extra = [(900, "a b", "en", "s0", "clash", False), *[(None, f"no id, text {i % 2}", None, None, None, None) for i in range(6)]]
    rows = docs.union(spark.createDataFrame(extra, SCHEMA))
    out = corpus_pipeline.near_dedup_stage(spark, rows, "").collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    texts = [r.text for r in out if r.doc_id is None]
    assert len(texts) == len(set(texts)) >= 2
    judged = near_dedup.near_duplicates(rows).select("row.doc_id", "component_id").collect()
    assert set(ids) == {r.component_id for r in judged} - {None}
    given = {tuple(r) for r in rows.collect()}
    assert {tuple(r) for r in out} <= given
    assert corpus_pipeline.near_dedup_stage(spark, none, "").collect() == []


def test_trees_learn_from_every_candidate(spark):
    """More candidates than a sample would hold: all of them count, and a table teaches what its rows would."""
    rng = random.Random(21)
    rows = [(f"call +1 {rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} or order {rng.randint(10**9, 10**10)} x",) for _ in range(6000)]
    found = pii._candidates(spark.createDataFrame(rows, "text string"))
    counted = pii.counted_features(found).collect()
    assert sum(r.n for r in counted) == found.count() > pii.SAMPLE
    assert sum(r.n for r in counted if r.held) <= pii.HELD_OUT * found.count()
    table = spark.createDataFrame([(r.x, r.y, r.n) for r in counted], "x array<double>, y int, n long").repartition(3)
    x = np.repeat(np.array([r.x for r in counted]), [r.n for r in counted], axis=0)
    y = np.repeat(np.array([r.y for r in counted], float), [r.n for r in counted])
    of_table, of_rows = boosting.fit_table(table), boosting.fit(x, y)
    assert np.array_equal(of_table.log_odds(x), of_rows.log_odds(x)) and of_table.base == of_rows.base
    assert ((of_table.probability(x) > 0.5) == (y > 0.5)).mean() > 0.98


def test_few_rows_of_a_query_leave_their_tasks():
    """Rows in many small parts, a third of them copies: what leaves a part is bounded by the seeds, and nothing is lost."""
    rng, k = np.random.default_rng(4), 20
    x = rng.normal(size=(6000, 16))
    x[::3] = x[0]
    ids, q = np.arange(6000), np.arange(0, 6000, 100)
    seeds = np.sort(rng.permutation(6000)[:1500])
    score, last = neighbours._bounds(q, x[q], seeds, x[seeds], k)
    parts = [neighbours._met(q, x[q], ids[p::200], x[p::200], k, score, last) for p in range(200)]
    found = neighbours._best(*(np.concatenate(c) for c in zip(*parts)), k)
    want = neighbours._met(q, x[q], ids, x, k)
    assert all(np.array_equal(f, w) for f, w in zip(found, want)) and len(want[0]) == k * len(q)
    assert sum(len(p[0]) for p in parts) <= 6 * k * len(q)  # 200 * k without bounds


def test_neighbours_by_growing_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x[::3] = x[0]
    monkeypatch.setattr(neighbours, "SEEDS", 100)
    monkeypatch.setattr(neighbours, "STEP", 4)
    got = _recalls(spark, x, range(0, 1500, 20))
    assert sum(got.values()) / len(got) >= 0.9


def test_texts_travel_to_python_once(docs, monkeypatch):
    seen, given_to = [], near_dedup.with_classes
    monkeypatch.setattr(near_dedup, "with_classes", lambda d, *a, **k: seen.append(d.schema) or given_to(d, *a, **k))
    out = near_dedup.near_duplicates(docs)
    assert collections.Counter(map(tuple, (r.row for r in out.collect()))) == collections.Counter(map(tuple, _rows()))
    assert out.schema["row"].dataType.names == docs.columns
    rows = [s["row"].dataType.names for s in seen if "row" in s.names]
    assert rows and all("text" not in names for names in rows)


def test_words_of_letters_need_no_pattern(monkeypatch):
    """Words of letters, with a mark or without, and all of ASCII are cut without the general pattern."""
    texts = ["Où été, ÉTÉ! Œuvre; the The. x: it's a1 Est*** don't.", "µ? ª, Ÿ: ſ ß. İ. ﬁ! <|x|>, ab1c . ,;"]
    ids = word_tokens.WordIds()
    want = [word_tokens.packed(ids._whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [ids.encode(t.encode()) for t in texts] == want
    monkeypatch.setattr(word_tokens, "_PIECES", None)
    assert word_tokens.WordIds().encode(texts[0].encode()) == want[0]
