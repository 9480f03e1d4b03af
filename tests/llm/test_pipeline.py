"""The pipeline's stages, each against its rule on a small fixture."""

import random

import corpus_pipeline
from timetide.llm import bpe, mixing
from timetide.llm.registry import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("w" + str(rng.randint(0, 4000)) for _ in range(n))
    shared = text(60)
    rows = [[i, text(80), "en", "ab"[i % 2], 0] for i in range(120)]
    for i in range(0, 60, 3):
        rows[i][1] += " vilestem vilestem " + text(5) + " vilestem"
    for i in (61, 62):
        rows[i][1] += " " + shared
    rows[70][1] = rows[71][1]
    for r in rows:
        r[4] = len(r[1])
    rows.append([500, None, None, None, None])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60 and i % 3 == 0), 1) for i in range(110)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect()
    ids = {r.doc_id for r in kept["toxicity"]}
    assert len(ids & set(range(0, 60, 3))) <= 2 and set(range(60, 120)) <= ids and 500 in ids
    assert 71 not in {r.doc_id for r in kept["near duplicates"]} and 70 in {r.doc_id for r in kept["near duplicates"]}
    texts = {r.doc_id: r.text for r in kept["repeated passages"]}
    assert shared in texts[61] and "".join(shared.split()[:3]) not in (texts[62] or "").replace(" ", "") and texts[500] is None
    report = mixing.mix_report(spark.read.parquet(f"{tmp_path}/2")).collect()
    assert len(kept["mixing"]) == sum(r.copies for r in report)
    codec = bpe.BpeCodec(open(VOCABULARY, "rb").read())
    mixed = {r.doc_id: r.text or "" for r in kept["mixing"]}
    assert all(codec.decode(bytes(r.ids)) == mixed[r.doc_id] for r in kept["tokens"])
