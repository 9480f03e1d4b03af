"""Operator 12 against the sentencepiece library: odd texts, every piece, whole rows through the query."""

import hashlib
import random

import pytest
import sentencepiece

from timetide.llm import pieces, registry


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)


@pytest.fixture(scope="module")
def codec():
    with open(registry.PIECE_MODEL, "rb") as f:
        return pieces.PieceCodec(f.read())


def odd_texts(library, many):
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", " \n", "é", "日本", "12", "!!", "\x85", "\xa0", "\x1c", "q" * 60, "😀", "\r\n", "▁", "<s>", "</s>", "<unk>", "<0x41>", "aaaa", "\x00", "﻿", "ﬁ", "é", "self."]
    bits += [library.id_to_piece(rng.randint(259, 31999)) for _ in range(400)] + [chr(rng.randint(32, 0x2FFF)) for _ in range(60)]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(many)]


def test_odd_texts(codec, library):
    for text in odd_texts(library, 4000):
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)


def test_pieces_and_blanks(codec, library):
    for i in range(259, library.get_piece_size()):
        text = library.id_to_piece(i).replace("▁", " ")
        assert codec.encode(text) == library.encode(text)
    for n in range(70):
        for text in (" " * n, "x" + " " * n + "y", " " * n + "\n" + " " * n):
            assert codec.encode(text) == library.encode(text)


def test_long_words(codec, library):
    rng = random.Random(6)
    for text in ("".join(rng.choice("abcdetnqu") for _ in range(60_000)), "a" * 60_000, "日本\n" * 9_000, " " * 20_000):
        assert codec.encode(text) == library.encode(text)


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.randrange(3, 32000) if rng.random() < 0.6 else rng.randint(3, 258) for _ in range(rng.randint(1, 6))]
        assert codec.decode(ids) == library.decode(ids)


def test_failed_places_are_marked(codec):
    """Backtracking happens, and gives what merging gives."""
    for text in ("▁unaaaa", "▁tthhee", "▁ininging"):
        got = codec._backtrack(text)
        assert sum(codec.size[r] for r in got) == len(text)
        assert all(codec.compatible(a, b) for a, b in zip(got, got[1:]))


def test_caches_are_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 20)
    with open(registry.PIECE_MODEL, "rb") as f:
        codec = pieces.PieceCodec(f.read())
    for text in odd_texts(library, 300):
        assert codec.encode(text) == library.encode(text)
        assert len(codec.pairs) <= 20


def message(*fields):
    """A protocol buffer message of integers and raw bytes."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v for k, v in fields)


@pytest.mark.parametrize("trainer, normal", [(((3, 1), (35, 1)), ((3, 1), (4, 0))), (((3, 2),), ((4, 0),)), (((3, 2), (35, 1)), ((2, b"map"), (4, 0))), (((3, 2), (35, 1)), ((4, 1),))])
def test_refuses_other_models(trainer, normal):
    with pytest.raises(ValueError):
        pieces.PieceCodec(message((1, message((1, b"a"))), (2, message(*trainer)), (3, message(*normal))))


def test_query_over_odd_rows(spark, tmp_path, library):
    texts = [*odd_texts(library, 300), "", None, " ", "word " * 5000, "é" * 3000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a b", None, None), (None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_pieces"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def expected(doc_id, text):
        ids = library.encode(text or "")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))

    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)


def test_round_trip_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "Hello  world\n")], "doc_id long, text string")
    (r,) = pieces.piece_encode(rows, registry.PIECE_MODEL).collect()
    assert r.decoded == "Hello  world\n" and r.n_tokens == len(r.ids)
    assert pieces.piece_encode(rows.limit(0), registry.PIECE_MODEL).collect() == []
