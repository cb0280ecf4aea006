"""The subsequence kernel against enumeration of subsequences, and the machine's defined results at the edges."""

from itertools import combinations

import numpy as np
import pytest

from triagelake.llm import toxicity


def naive(s, t, n):
    """Sum over common subsequences of length n of LAMBDA to the power of both spans."""
    spans = lambda w: [(tuple(w[i] for i in at), at[-1] - at[0] + 1) for at in combinations(range(len(w)), n)]
    return sum(toxicity.LAMBDA ** (a + b) for x, a in spans(s) for y, b in spans(t) if x == y)


def codes(word):
    return np.array([ord(c) - 96 for c in word], np.uint8)


@pytest.mark.parametrize("s, t", [("idiot", "idiot"), ("idiot", "idxiot"), ("abab", "baba"), ("aaaa", "aaa"), ("stupid", "cupid"), ("abc", "xyz"), ("abcabc", "cabcab")])
def test_kernel_is_that_of_all_subsequences(s, t):
    got = toxicity.kernel(codes(s)[None], codes(t)[None])[0]
    want = [naive(s, t, n) for n in toxicity.LENGTHS]
    assert got == pytest.approx(want, rel=1e-4, abs=1e-7)


def test_padding_matches_nothing_and_rows_are_independent():
    words = ["abcd", "bcda", "aabb"]
    pad = np.stack([np.append(codes(w), np.zeros(3, np.uint8)) for w in words])
    got = toxicity.by_length(pad, np.broadcast_to(pad[0], pad.shape), np.array([4, 4, 4]), 4)
    assert got == pytest.approx(np.array([[naive(w, "abcd", n) for n in toxicity.LENGTHS] for w in words]), rel=1e-4, abs=1e-7)


PLACES = [f"{x}{y}" for x in ("nor", "sou", "riv", "sto", "gla", "met") for y in ("th", "ern", "en", "ish", "ock", "und", "alk")]
TOXIC = [f"you are {w} blarghead today" for w in PLACES]
CLEAN = [f"we walked along {w} road and had a fine day" for w in PLACES]


def scores(model, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return model.scores(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))


def test_learned_insults_are_found_with_inserted_letters_and_apart():
    model = toxicity.train(TOXIC, CLEAN)
    s = scores(model, ["a blarghead", "a blxarghead!", "a BLARGHEADS", "b l a r g h e a d", "a fine day by the river", "", "word " * 50_000 + "blarghead"])
    assert (s[[0, 1, 2, 3, 6]] >= 0.5).all() and (s[[4, 5]] < 0.5).all()


@pytest.mark.parametrize("toxic, clean, share", [([], ["a b c"], 0.0), (["x"], [], 1.0), ([], [], 0.0), (["ab"] * 3, ["ab"] * 1, 0.75)])
def test_without_landmarks_scores_are_the_share(toxic, clean, share):
    assert scores(toxicity.train(toxic, clean), ["toxic text", ""]) == pytest.approx([share] * 2, abs=1e-12)


def test_tables_edge_cases(spark):
    model = toxicity.train(TOXIC, CLEAN)
    shape = "doc_id long, text string, score string, predicted string, _in int"
    assert toxicity.score(spark.createDataFrame([], shape), model).collect() == []
    rows = [(1, "a blarghead", "x", "y", 1), (1, "a blarghead", "x", "y", 1), (None, None, None, None, None), (2, "", "", "", 0)]
    docs = spark.createDataFrame(rows, shape)
    got = sorted((r.doc_id or 0, r.predicted, r["_in"] or 0) for r in toxicity.score(docs, model).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 0)]
    assert sorted(toxicity.remove_toxic(docs, model).collect(), key=str) == sorted([r for r in docs.collect() if r.doc_id != 1], key=str)
