"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows.

Odd rows: nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names.
"""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timetide.llm import bpe, hamming, jaccard, langid, licenses, quality, quality_rules, substrings, toxicity
from timetide.llm.registry import VOCABULARY
from timetide.llm.textops import TextBlock

# Extra columns carry names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, label string, rank int"
WORDS = "the of and to in is river stone light cloud field house green quiet walk seven paper window morning garden".split()


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def corpus():
    rng = random.Random(4)
    shared, base = passage(rng, 60), passage(rng, 80)
    texts = [passage(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [passage(rng, 30) + " " + shared + "\n" + passage(rng, 30) for _ in range(6)]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9))
        texts.append(" ".join(w))
    texts += [base.upper(), texts[0], texts[0], "", "   \n", "one", "one two", "One  two", "é日本 " * 30, "a b c d e " * 8, passage(rng, 20_000)]
    rows = [(i, t, "en", "s", len(t), 0.5, 1, "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, None, None, None, None, None, None, None, None), (900, None, None, None, None, None, None, None, None), (None, texts[1], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_bpe_round_trip_and_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    got = bpe.bpe_encode(docs, VOCABULARY).collect()
    assert len(got) == docs.count()
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    for r in got:
        assert texts[(r.doc_id, r.decoded)] > 0
        ids = np.array(t.encode(r.decoded, add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    t, codec, rng = Tokenizer.from_file(VOCABULARY), bpe.BpeCodec(open(VOCABULARY, "rb").read()), random.Random(1)
    bits = [" ", "  ", "\n", "\t", " \n", "a", "the", "'s", "<|endoftext|>", "é", "日本", "12", "!!", "\x85", "\xa0", "\x1c", "q" * 90, "😀", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = codec.encode_batch(texts)
    assert got == [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [codec.decode(x) for x in got] == texts


def test_bpe_refuses_other_vocabularies():
    told = json.loads(open(VOCABULARY, "rb").read())
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"model": told["model"] | {"vocab": {str(i): i for i in range(1 << 16)}}}):
        with pytest.raises(ValueError):
            bpe.BpeCodec(json.dumps(told | change).encode())


def removed(rows, width):
    """Brute force over (id, text hash order aside) rows: words covered by a window that starts earlier."""
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if tuple(w[i : i + width]) in seen:
                gone[i : i + width] = [True] * width
            else:
                seen[tuple(w[i : i + width])] = d
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings_against_brute_force(docs):
    got = substrings.dedup_substrings(docs).collect()
    assert len(got) == docs.count() and set(docs.columns) < set(got[0].asDict())
    want = removed({(10**18 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None or r.text is not None}, 20)
    for r in got:
        if r.doc_id is not None or r.text is not None:
            assert (r["__n_words"], r["__n_removed"], r["__kept"]) == want[10**18 if r.doc_id is None else r.doc_id]
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def linked(rows):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(least.get(root(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs).collect())
    assert got == linked(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    stay = [r.doc_id for r in kept.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).collect()]
    assert len(stay) == len(set(stay))
    assert set(stay) == {int(c) for d, n, c in got if n and c != "None"}


def test_answers_are_derived_from_similar_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = []
    for i in range(60):
        own = base.copy()
        own[rng.choice(200, rng.integers(0, 30), replace=False)] = rng.integers(0, 1 << 60, 1)[0]
        sets.append(np.unique(own[: 200 - i]))
    sets.sort(key=len)
    answers = jaccard.Answers(sets)
    for x in (59, 58, 10, 57, 0):
        assert answers.of(x).tolist() == [len(np.intersect1d(sets[x], y)) for y in sets]
    one = jaccard.Answers(sets)
    one.of(59)
    whole = one.read
    one.of(58)
    assert one.read - whole < whole  # the second set reads fewer lists
    for y, root, head, o in jaccard.group_answers(sets, 80):
        assert o == len(np.intersect1d(sets[y], sets[head])) and 100 * o >= 80 * (len(sets[y]) + len(sets[head]) - o)
        assert root == head or any(u == head and r == root for u, r, _, _ in jaccard.group_answers(sets, 80))


def large_group():
    """A few hundred near copies of one text around the limit of similarity, some of whose links only hold through others."""
    rng = random.Random(21)
    base = [f"g{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"m{rng.randint(0, 400)}"
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, f"alone {i} " + passage(rng, 20)) for i in range(30)]


@pytest.mark.parametrize("first,turns,open_pairs", [(True, 4, 20), (False, 4, 0), (False, 0, 0), (True, 2, 0)])
def test_jaccard_large_group(spark, first, turns, open_pairs):
    """Each way to a whole answer: from first answers, from turns only, and by comparing all that is left."""
    rows = large_group()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known, classes, posting = jaccard._prepared(docs, 5, 80)
    heads = jaccard.first_answers(posting, 80)
    labels = jaccard.connected(posting, heads if first else heads.limit(0), 80, turns, open_pairs)
    named = classes.join(labels, "cid", "left").select("f1", "f2", F.coalesce("label", "cid").alias("node"))
    got = [(r.doc_id, r.node) for r in known.join(named, ["f1", "f2"]).collect()]
    least = {}
    for d, node in got:
        least[node] = min(d, least.get(node, d))
    want = {int(d): int(c) for d, _, c in linked(rows)}
    assert {d: least[node] for d, node in got} == want


def test_jaccard_equal_ids_and_ids_without_texts(spark):
    rng = random.Random(5)
    a, b = passage(rng, 40), passage(rng, 40)
    rows = [(1, a, "x"), (1, b, "y"), (None, a + " more", "x"), (None, passage(rng, 30), "z"), (None, passage(rng, 30), "z"), (2, b, None), (3, None, "n"), (3, None, "n"), (None, " ", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], *rows[3:5], *rows[6:]], key=str)
    with pytest.raises(ValueError):
        jaccard.near_duplicates(docs.withColumn("doc_id", F.lit("x")))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_whose_sums_of_powers_agree_are_told_apart(spark):
    """Thue-Morse words and their mirror images collide in every polynomial modulo a power of two."""
    swap = str.maketrans("ab", "ba")
    for n in (1024, 2048, 4096, 16):
        w = thue_morse(n)
        h = TextBlock([f"{w} {w.translate(swap)}".encode()]).word_hashes()
        assert h[0] != h[1]
    w = thue_morse(2048)
    lines = "\n".join([f"{w} word", f"{w.translate(swap)} word"])
    filler = " ".join(f"f{i}" for i in range(19))
    rows = [(1, f"{w} {filler}"), (2, f"{w.translate(swap)} {filler}"), (3, lines), (None, w + " " + filler.upper()), (None, w.translate(swap) + " " + filler.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["__n_removed"] for r in substrings.dedup_substrings(docs).collect()} == {0}
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs).collect()) == linked(rows)
    assert {r.n_dup_lines for r in quality_rules.apply_rules(docs).collect()} == {0}


def test_quality_rules_against_brute_force(docs):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_rules.apply_rules(docs).collect()}
    for row in docs.collect():
        w, seen, dup = words(row.text), set(), 0
        for line in (row.text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = [False] * len(w)
        for i in range(len(w) - 7):
            if c[tuple(w[i : i + 8])] > 1:
                cover[i : i + 8] = [True] * 8
        r = got[(row.doc_id, len(w), sum(map(len, w)))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", row.text or "")), dup, sum(cover))
        assert r.base_failed == (len(w) < 20 or 100 * sum(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def test_cascade_order_never_changes_the_verdict():
    block = TextBlock([("# $ " * 30).encode(), b"plain words of some text here " * 5, b"AAA BBB! " * 40, b"w w w w w w w " * 9])
    stats, alive = quality_rules.TextStats.of(block), np.ones(4, bool)
    kept = quality_rules.cascade(quality_rules.RULES, block, stats, alive)[0]
    assert (kept == quality_rules.cascade(quality_rules.RULES[::-1], block, stats, alive)[0]).all()
    slow, sharp = quality_rules.RuleEstimate("a", 1.0, 0.5), quality_rules.RuleEstimate("b", 0.1, 0.4)
    assert [r.name for r in quality_rules.order_rules(quality_rules.RULES[:2], [slow, sharp])] == [r.name for r in quality_rules.RULES[1::-1]]


def test_hamming_against_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(64)], i) for i in range(300)] + [(300 + i, [1.0] * 64, 1) for i in range(40)]
    vectors += [(900, None, 1), (901, [], 1), (None, [1.0] * 64, 1), (5, vectors[5][1], 5)]
    df = spark.createDataFrame(vectors, "id long, embedding array<double>, distance int").withColumn("code", hamming.sign_code(F.col("embedding")))
    got = sorted((r.query_id, r.rank, r.neighbor_id, r.distance) for r in hamming.top_k(df, df.filter("id % 100 = 0"), 7).collect())
    points = {i: [x > 0 for x in v] for i, v, _ in vectors if i is not None and v}
    want = []
    for q in points:
        if q % 100 == 0:
            best = sorted((sum(a != b for a, b in zip(points[q], c)), i) for i, c in points.items())[:7]
            want += [(q, n, i, d) for n, (d, i) in enumerate(best, 1)]
    assert got == sorted(want)
    few = df.filter("id < 3")
    assert hamming.top_k(few, few.filter("id = 0"), 7).count() == 3
    assert hamming.top_k(df.limit(0), df.limit(0), 7).count() == 0


def test_language_model_held_out_and_odd_rows(spark, docs):
    rng = random.Random(2)
    kinds = {"aa": "bade fogi lume", "bb": "xotry kwiz vupp", "cc": "ñandú çéda öst"}
    rows = [(i, " ".join(rng.choice(s.split()) + rng.choice("aeiou") for _ in range(30)), k) for i, (k, s) in enumerate(list(kinds.items()) * 60)]
    model = langid.fit([t.encode() for _, t, _ in rows[:120]], [k for _, _, k in rows[:120]])
    p = model.predict([t.encode() for _, t, _ in rows[120:]]).argmax(axis=1)
    assert [model.languages[x] for x in p] == [k for _, _, k in rows[120:]]
    for r in langid.identify(docs, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred in kinds or r.lang_pred == "und" and r.score == 0)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ?!"), (4, "a")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.identify(odd, model).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert {r.lang_pred for r in langid.identify(odd, langid.fit_on(odd.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def labelled(n, mark):
    rng = random.Random(n)
    out = []
    for i in range(n):
        w = passage(rng, rng.randint(20, 90)).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), mark(rng))
        out.append((" ".join(w).encode(), int(i % 3 == 0)))
    return out


def test_toxicity_held_out_and_odd_rows(docs):
    rows = labelled(700, lambda rng: "vilestem" + rng.choice(["a", "or", "ung", "ia", "os"]))
    model = toxicity.fit([t for t, _ in rows[:500]], np.array([y for _, y in rows[:500]]), 1 / 3)
    p, y = model.score([t for t, _ in rows[500:]]), np.array([y for _, y in rows[500:]])
    assert ((p >= 0.5) == y).mean() > 0.95
    long = passage(random.Random(8), 4000).encode() + b" "
    assert (model.score([b"", b"  ", long]) < 0.5).all() and model.score([long + rows[0][0] + long])[0] > model.score([long])[0]
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    carried = toxicity.score_toxicity(docs, model, carry=True)
    assert carried.columns == [*docs.columns, "__toxicity"] and carried.count() == docs.count()
    assert (toxicity.fit([], np.array([]), 0.5).score([b"x"]) == 0).all()


def test_quality_held_out_and_odd_rows(docs):
    rows = labelled(600, lambda rng: "### $$$ %%% |||")
    x = quality.statistics(TextBlock([t for t, _ in rows]))
    y = np.array([1 - y for _, y in rows])
    model = quality.QuadraticDiscriminant().fit(x[:400], y[:400])
    assert ((model.score(x[400:]) >= 0.3) == y[400:]).mean() > 0.97
    assert len(model.factors) == 2 and all(np.allclose(f, np.tril(f)) for f in model.factors)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert (quality.QuadraticDiscriminant().fit(x[:0], y[:0]).score(x[:3]) == 0.5).all()


def test_licenses_against_brute_force(spark):
    rng, names = random.Random(6), list(licenses.TEMPLATES)
    texts = [passage(rng, 40) + "\n" + licenses.TEMPLATES[n] + "\n" + passage(rng, 50) for n in names] + [passage(rng, 90), "", None, licenses.TEMPLATES[names[1]].upper()]
    half = licenses.TEMPLATES["MIT permission"].split()
    texts.append(" ".join(half[: len(half) // 2]))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1)], "doc_id long, text string, template string, h int")
    got = {(r.doc_id, r.template) for r in licenses.scan(docs).collect()}
    cut = lambda t: [w for w in re.split(licenses.MARKS, (t or "").lower()) if w]
    five = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = set()
    for i, t in enumerate(texts):
        s = five(cut(t))
        for name, template in licenses.TEMPLATES.items():
            k = set(five(cut(template)))
            if any(100 * len(k & set(s[a : a + 2 * len(k)])) >= 80 * len(k) for a in range(0, len(s), len(k))):
                want.add((i, name))
    assert got == want and all((i, n) in got for i, n in enumerate(names))
    assert licenses.scan(docs.limit(0)).count() == 0
