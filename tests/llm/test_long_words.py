"""Very long words, and empty tables, for the two tokenizers and the operators on vectors."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timetide.llm import bpe, hamming, licenses, pieces, registry


def test_words_of_megabytes(spark):
    texts = ["x" * 1_000_000, "abc" * 300_000 + " end", "é" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(registry.VOCABULARY)
    got = {r.doc_id: r for r in bpe.bpe_encode(docs, registry.VOCABULARY).collect()}
    for i, text in enumerate(texts):
        assert got[i].decoded == text and bytes(got[i].ids) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for r in pieces.piece_encode(docs, registry.PIECE_MODEL).collect():
        assert r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe.bpe_encode(docs, registry.VOCABULARY).collect() == []
    assert licenses.scan(docs).collect() == []
    points = spark.createDataFrame([], "id long, code binary, rank int")
    points = points.select("id", hamming.sign_code(F.array().cast("array<float>")).alias("code"), "rank")
    assert hamming.top_k(points, points, k=3).collect() == []
