"""Hashes of words under a key: words made to collide under a public hash are told apart, by op7 and op8 as a whole too."""

import numpy as np
import pytest

from timetide.llm import jaccard, registry, textops
from timetide.llm.textops import FIXED, TextBlock, draw, window_hashes

# Words of one hash under the public hash that was used here before: the second eight bytes cancel what the first differ in.
SHINGLES = ("mgsahbam!!!!!!!@", 'cfqlrxaug,pm"\\bc')
WINDOWS = ("wxkqmpjoaZT.>NZ\\", "pjcttwgwL~}Y+')H")


@pytest.mark.parametrize("pair", [SHINGLES, WINDOWS])
@pytest.mark.parametrize("which", [0, 1])
def test_words_of_one_public_hash_differ(pair, which):
    for key in (FIXED, draw()):
        a, b = TextBlock([" ".join(pair).encode()]).word_hashes(which, key)
        assert a != b


def test_short_words_never_meet():
    words = [bytes([a, b]) for a in range(33, 127) for b in range(33, 127)] + [bytes([a]) * n for a in range(33, 127) for n in (1, 3, 4, 5, 6, 7)]
    assert len(np.unique(TextBlock([b" ".join(words)]).word_hashes(0, draw()))) == len(words)


def test_hashes_hang_on_the_key_and_on_nothing_else(monkeypatch):
    monkeypatch.setattr(textops, "MOST_DIGESTS", 10)
    rng = np.random.default_rng(1)
    words = ["w" * int(n) + str(i % 50) for i, n in enumerate(rng.integers(1, 90, 400))]
    one, other = draw(), draw()
    whole = TextBlock([" ".join(words).encode()]).word_hashes(0, one)
    apart = np.concatenate([TextBlock([w.encode(), b"x"]).word_hashes(0, one)[:1] for w in words])
    assert (whole == apart).all()
    assert (whole != TextBlock([" ".join(words).encode()]).word_hashes(0, other)).all()
    assert (whole != TextBlock([" ".join(words).encode()]).word_hashes(1, one)).all()
    assert len({(w, h) for w, h in zip(words, whole.tolist())}) == len(set(words)) == len(set(whole.tolist()))


@pytest.mark.parametrize("width", [1, 2, 5, 20])
def test_windows_are_equal_where_their_words_are(width):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 3000).astype(np.uint64)
    h = window_hashes(textops.mix(words), width, 0, draw())
    keys = [tuple(words[i : i + width].tolist()) for i in range(len(words) - width + 1)]
    assert len(h) == len(keys) and len(set(h.tolist())) == len(set(keys)) == len(set(zip(keys, h.tolist())))


def test_disjoint_sets_do_not_link(spark):
    rows = [(1, "x y z w " + SHINGLES[0]), (2, "x y z w " + SHINGLES[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    assert jaccard.keep_one(docs).count() == 2


def test_single_windows_stay(spark, tmp_path):
    tail = " ".join(f"w{i}" for i in range(19))
    spark.createDataFrame([(1, f"{WINDOWS[0]} {tail}"), (2, f"{WINDOWS[1]} {tail}"), (3, f"{WINDOWS[1]} {tail}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op8_substring_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 20}
