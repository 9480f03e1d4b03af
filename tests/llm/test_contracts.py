"""The queries by which models are judged, through the registry: columns, held-out rows, thresholds, and that labels and languages of held-out rows change nothing."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from timetide.llm import registry

VOICES = {"en": "the of and river stone light house green walk window morning garden paper", "de": "der die und ist nicht haus grün fluss stein licht fenster morgen garten", "fr": "le la et rivière pierre lumière maison vert marche fenêtre matin jardin papier"}
BAD = "vile rotten scum trash idiot wretch filth"


def documents():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(360):
        lang = rng.choice(sorted(VOICES))
        words = [rng.choice(VOICES[lang].split()) for _ in range(rng.randint(25, 90))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.5
        if toxic:
            words[5:5] = rng.choices(BAD.split(), k=12)
        if not good:
            words = [w.upper() + "!!!" if rng.random() < 0.5 else w * 2 for w in words]
        rows.append((i, " ".join(words), lang if i % 11 else None, rng.choice("abc"), 1, 0.5, True))
        if i % 7:
            labels.append((i, int(good), int(toxic)))
    odd = [None, "", " \n", "123 456 !!", "é", "word " * 40_000, "日本語 テキスト"]
    rows += [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(odd)]
    # A repeated row, one without an id, one of nulls only.
    rows += [rows[3], (None, rows[4][1], "en", "a", 1, 0.5, True), (None,) * 7]
    return rows, labels + [(None, 1, 0), (5, None, None), labels[2]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean"


def held_out(doc_id, of, rest):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of == rest


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def result(spark, name, path):
    return told_rows(registry.QUERIES[name](spark, path).collect())


def told_rows(rows):
    """Rows in one order; sums of 32-bit numbers hang on how texts share a block, so scores are compared nearly."""
    key = lambda r: (str(r.doc_id), round(r.score, 2))
    return [tuple(pytest.approx(v, abs=1e-4) if isinstance(v, float) else v for v in r) for r in sorted(rows, key=key)]


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    rows, labels = documents()
    return rows, labels, write(spark, tmp_path_factory.mktemp("told"), rows, labels)


def test_language(spark, told, tmp_path):
    rows, labels, path = told
    df = registry.QUERIES["op1_language_id"](spark, path)
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = df.collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    lang = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None}
    for r in got:
        assert r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1
        if r.doc_id is not None:
            none = not any(c.isalpha() for c in lang[r.doc_id][0] or "")
            assert r.lang_pred == "und" if none else r.lang_pred in VOICES
    judged = [(lang[r.doc_id][1], r.lang_pred) for r in got if r.held_out and r.doc_id is not None and lang[r.doc_id][1]]
    assert len(judged) > 40 and sum(a == b for a, b in judged) >= 0.95 * len(judged)
    # Languages of held-out rows, and sources of all rows, change nothing.
    other = [(i, t, "xx" if held_out(i, 4, 2) else g, "other", *rest) for i, t, g, _, *rest in rows]
    again = registry.QUERIES["op1_language_id"](spark, write(spark, tmp_path, other, labels)).collect()
    # What no training text resembles (the odd rows) hangs on rounding.
    seen = lambda rows: [r for r in rows if r.doc_id is None or r.doc_id < 1000]
    assert told_rows(seen(again)) == [tuple(r) for r in sorted(seen(got), key=lambda r: (str(r.doc_id), round(r.score, 2)))]


@pytest.mark.parametrize(("name", "column", "threshold", "least"), [("op2_toxicity", 2, 0.5, 0.9), ("op4_quality", 1, 0.3, 0.85)])
def test_scores(spark, told, tmp_path, name, column, threshold, least):
    rows, labels, path = told
    df = registry.QUERIES[name](spark, path)
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    label = {r[0]: r[column] for r in labels}
    for r in got:
        assert r.held_out == held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    judged = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id is not None and label.get(r.doc_id) is not None]
    assert len(judged) > 30 and sum(a == b for a, b in judged) >= least * len(judged)
    # Labels of held-out rows, and languages and sources of all rows, change nothing.
    flipped = [(i, 1 - q, 1 - t) if q is not None and held_out(i, 5, 0) else (i, q, t) for i, q, t in labels]
    other = [(i, t, "xx", "other", *rest) for i, t, _, _, *rest in rows]
    assert result(spark, name, write(spark, tmp_path, other, flipped)) == [tuple(r) for r in sorted(got, key=lambda r: (str(r.doc_id), round(r.score, 2)))]


@pytest.mark.parametrize("name", ["op1_language_id", "op2_toxicity", "op4_quality"])
def test_empty_tables_and_no_labels(spark, told, tmp_path, name):
    rows, labels, _ = told
    empty = write(spark, tmp_path / "empty", rows[:1], labels[:1])
    docs, told_labels = spark.read.parquet(f"{empty}/documents.parquet"), spark.read.parquet(f"{empty}/labels.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    told_labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert result(spark, name, f"{tmp_path}/none") == []
    docs.withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/bare/documents.parquet")
    told_labels.filter("false").write.parquet(f"{tmp_path}/bare/labels.parquet")
    (r,) = registry.QUERIES[name](spark, f"{tmp_path}/bare").collect()
    assert r.doc_id == 0 and 0 <= r.score <= 1


SQL_QUERIES = ["op5_quality_rules", "op7_jaccard_join", "op8_substring_dedup"]


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_same_rows_as_the_sql(spark, told, tmp_path, name):
    import duckdb

    rows, labels, _ = told
    rng = random.Random(12)
    texts = [r[1] for r in rows[:80]] + [r[1] for r in rows[360:367]]
    texts += [t + " more" for t in texts[:20]] + [texts[30][:90] + " " + texts[31] for _ in range(6)]
    texts += ["a b c d " * 9, "x\n" * 40, "same line here\n" * 8, "####" * 5 + " w" * 30, "7" * 30 + " " + "word " * 25, "AB " * 40, "go go go " * 12, " ".join(rng.choice("pqr") for _ in range(60))]
    path = write(spark, tmp_path, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)], labels)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    cursor = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = registry.QUERIES[name](spark, path)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(cursor.fetchall())


def test_languages_of_long_texts_only_are_learned(spark):
    from timetide.llm import langid

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(VOICES[g].split()) for _ in range(9000 if g == "fr" else 60)), g) for i, g in enumerate(["en", "de", "fr"] * 12)]
    model = langid.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    got = langid.identify(spark.createDataFrame([(1, "la maison et le jardin vert " * 3), (2, VOICES["fr"] * 2000)], "doc_id long, text string"), model)
    assert {r.lang_pred for r in got.collect()} == {"fr"}
