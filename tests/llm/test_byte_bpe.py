"""Byte-level BPE by prefix tables against the public library."""

import base64
import hashlib
import random

import numpy as np
import pytest

from panelworks.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
ODD = ["", " ", "a", "don't  stop\n\n\t now", "x" * 700, " " * 300 + "y", "　\x1c\x85 é", "漢字 한국어 русский 12³ ½", "😀" * 40, "\r\n" * 50 + "end", "ÀÉÎ" * 33, "á" * 20]


@pytest.fixture(scope="module")
def lib():
    with open(byte_bpe.ranks_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.Vocabulary.load(byte_bpe.ranks_path()), byte_bpe.split_pattern())


def _texts(count, seed):
    rng = random.Random(seed)
    pool = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000] + list("   \n\t''") * 80 + ["don't", " it's", " 12", "😀", "  the", "ing", "tion", "schön", "中文"] * 60
    return ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(count)]


def test_codes_equal_the_library(coder, lib):
    texts = ODD + _texts(3000, 1)
    for code, text in zip(coder.encode_all(texts), texts):
        assert np.frombuffer(code, "<u4").tolist() == lib.encode_ordinary(text)
        assert coder.decode(code) == text.encode()


def test_long_texts_are_read_in_runs_and_caches_may_fill(coder, lib, monkeypatch):
    monkeypatch.setattr(byte_bpe, "RUN", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 60)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 20)
    small = byte_bpe.Coder(byte_bpe.Vocabulary.load(byte_bpe.ranks_path()), byte_bpe.split_pattern())
    for text in [" ".join(_texts(60, 2)), *_texts(200, 3)]:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == lib.encode_ordinary(text)
    assert len(small.codes) <= 120 and len(small.before) <= 120 and len(small.vocabulary.pairs) <= 21


def test_every_prefix_is_encoded(coder, lib):
    data = " Zusammenhang überall nonsensewords".encode()
    table = byte_bpe.PrefixTable(coder.vocabulary)
    for at in range(len(data)):
        table.append(data[at : at + 1])
        assert table.ids() == lib._encode_single_piece(data[: at + 1])


def test_edits_of_one_match(coder):
    rng = random.Random(4)
    table = byte_bpe.PrefixTable(coder.vocabulary, bytes(rng.choices(b"aeinrst", k=3000)))
    computed = 0
    for _ in range(60):
        at, removed, added = rng.randrange(len(table.data)), rng.randrange(6), bytes(rng.choices(b"aeinrst", k=rng.randrange(6)))
        computed += table.edit(at, removed, added)
        assert table.last == byte_bpe.PrefixTable(coder.vocabulary, table.data).last
    assert computed < 60 * 300  # of about 3,000 entries an edit


def test_edits_of_a_text(coder, lib):
    rng = random.Random(5)
    text = byte_bpe.EditableText(coder, " ".join(_texts(100, 6)))
    assert text.ids() == lib.encode_ordinary(text.text)
    fresh = 0
    for k in range(300):
        at, removed = rng.randint(0, len(text.text)), rng.choice([0, 0, 1, 3, 20])
        added = rng.choice(["", " ", "\n ", "x", "'s", "ing ", "  two", "é", "7"])
        removed = min(removed, len(text.text) - at)
        fresh += text.append(added) if k % 5 == 0 else text.edit(at, removed, added)
        assert text.ids() == lib.encode_ordinary(text.text)
    assert fresh < 300 * 40


def test_query_rows(spark, lib):
    schema = "doc_id long, text string, ids string, decoded string, n_tokens string"
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD + [None, "word " * 60_000])]
    rows += [rows[3], (None, "no id", None, None, None), (None, None, None, None, None)]
    coded = byte_bpe.encode(spark.createDataFrame(rows, schema).repartition(3))
    got = sorted(byte_bpe.digests(coded).collect(), key=str)

    def want(i, text):
        ids = lib.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        return i, len(ids), digest, hashlib.sha256(lib.decode_bytes(ids)).hexdigest()

    assert sorted(map(tuple, got), key=str) == sorted((want(i, t) for i, t, *_ in rows), key=str)
    assert byte_bpe.digests(byte_bpe.encode(spark.createDataFrame([], schema))).count() == 0


def test_documents_equal_the_library(spark, lib):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.encode(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (lib.encode_ordinary(r.text or ""), (r.text or "").encode())
