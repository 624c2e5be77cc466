"""Token files against the plain tokenizer: ids, places, checksums, layout and selective reads."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import CHECK
from pyspark.sql import functions as F

from packwright.llm import byte_tokens, queries, token_files

SCHEMA = "doc_id long, text string, lang string, part string, ids int, position double"


def _rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß中1") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    odd = [None, "", " ", "a  b", "x\n\ny z \n", "tab\tend  x", "<|endoftext|> a<|endoftext|>b", "it's WE'LL  ", "\x1c \x85 q", text(30_000)]
    rows = [(i, t, "en" if i % 2 else None, "p", i, 0.5) for i, t in enumerate([*odd, *[text(rng.randint(0, 90)) for _ in range(300)]])]
    rng.shuffle(rows)
    return [*rows, rows[5], rows[5], (7, "other text of a known id", None, "p", 1, 0.1), (None, "no id", "fr", None, None, None)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokens.default_vocabulary())


def _data(whole, text):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.fixture(scope="module", params=token_files.ENCODINGS)
def stored(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(5)
    token_files.write_token_files(docs, path, encoding=request.param, row_group_bytes=1 << 16, page_rows=20)
    return request.param, path


def test_every_document_has_its_ids_and_place(spark, whole, stored):
    out = token_files.read_documents(spark, stored[1]).collect()
    at, got = 0, []
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        got.append((r.doc_id, r.ids, r.row.lang, r.row.part, r.row.ids, r.row.position))
    order = [-1 if g[0] is None else g[0] for g in got]
    assert order == sorted(order)
    want = [(i, _data(whole, t).tolist(), lang, p, n, x) for i, t, lang, p, n, x in _rows()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_stretch_is_the_same_as_the_whole_stream(spark, stored):
    rows = sorted(token_files.read_documents(spark, stored[1]).collect(), key=lambda r: r.start)
    stream = [i for r in rows for i in r.ids]
    rng = random.Random(1)
    for first, last in [(0, 1), (0, len(stream)), (5, 5), *[sorted(rng.sample(range(len(stream)), 2)) for _ in range(4)]]:
        found = sorted(token_files.read_stretch(spark, stored[1], first, last).collect(), key=lambda r: r.start)
        assert [i for r in found for i in r.ids] == stream[first:last]
        assert not found or found[0].start == first


def test_layout(spark, stored):
    encoding, path = stored
    groups = 0
    for name in glob.glob(f"{path}/data/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(i) for i in range(meta.num_columns)]
            ids = next(c for c in columns if c.path_in_schema.startswith("ids."))
            assert all(c.has_offset_index for c in columns)
            used = "RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings
            assert used == (encoding == "dictionary")
            assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
    assert groups > len(glob.glob(f"{path}/data/*.parquet"))


def test_metadata_and_single_documents_read_no_more_than_they_need(spark, stored, capsys):
    docs = token_files.read_documents(spark, stored[1])
    meta = docs.select("doc_id", "n_tokens", "row.lang").where("doc_id = 11")
    meta.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(doc_id,11)" in plan
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "ids" not in schema and "lang" in schema and "position" not in schema
    assert [r.doc_id for r in docs.where("doc_id = 11").collect()] == [11]


def test_no_documents(spark, tmp_path):
    path = f"{tmp_path}/t"
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), path)
    assert token_files.read_documents(spark, path).count() == 0
    assert token_files.read_stretch(spark, path, 0, 10).count() == 0
    with pytest.raises(ValueError):
        token_files.write_token_files(spark.createDataFrame([], SCHEMA), path + "2", encoding="plain")


def test_chunks_never_change_the_ids(whole):
    rng = random.Random(9)
    letters = [*"ab1'st .,!\n\t\r\x0b\x00\x1c\x85\xa0​　é中﻿", "  ", "<|endoftext|>", "'ll", " x"]
    encoder = byte_tokens.byte_ids()
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_line_breaks_before_letters_need_no_pattern(whole, monkeypatch):
    # The check of CPU seconds: such words are cut without the general patterns, and words that a generation
    # of the cache has lost are the same again.
    monkeypatch.setattr(byte_tokens, "CACHE_ENTRIES", 7)
    encoder = byte_tokens.ByteIds(byte_tokens.default_vocabulary())
    heads, rng = ["a", "Zeta,"], random.Random(2)
    lines = ["one\nTwo", "x.\nThen,", "so\nit\nIs;", "gr\nab:", "été,", "two", "Zeta,"]
    texts = [" ".join([rng.choice(heads), *rng.choices(lines, k=9)]) for _ in range(200)]
    chunks, cut = encoder._chunk, []
    monkeypatch.setattr(encoder, "_chunk", lambda chunk: cut.append(chunk) or chunks(chunk))
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert set(cut) <= set(heads)


def test_the_query(spark, whole):
    rows = spark.read.parquet(f"{CHECK}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for r in rows:
        data = _data(whole, r.text)
        want.append((r.doc_id, at, len(data), zlib.crc32(data.tobytes())))
        at += len(data)
    got = queries.QUERIES["op13_token_files"](spark, CHECK)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want
    assert got.where(F.col("start").isNull()).count() == 0
