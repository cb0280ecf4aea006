"""The semi-Markov model: its dynamic programme against all segmentations, its gradient, islands, and spans it adds."""

import numpy as np
import pytest

from triagelake.llm import pii


def segmentations(n, arcs, at=0):
    """All ways to cover tokens at..n with outside tokens (kind 0) and candidates."""
    if at == n:
        yield []
        return
    for rest in segmentations(n, arcs, at + 1):
        yield [(at, at + 1, 0)] + rest
    for i, j in arcs:
        if i == at:
            for rest in segmentations(n, arcs, j):
                for k in range(1, pii.N_TYPES):
                    yield [(i, j, k)] + rest


def value(model, toks, segs):
    total, before = 0.0, 0
    for i, j, k in segs:
        total += model.t[before, k] + (model.w[k, pii.span_features(toks, i, j)].sum() if k else 0.0)
        before = k
    return total


@pytest.mark.parametrize("text", ["a 12345 b", "12 345 6", "x at y dot com", "+1 (212) 5", "on 1.2.3.4", "no candidates here"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_best_segmentation_and_likelihood_are_those_of_enumeration(text, seed):
    r = np.random.default_rng(seed)
    model = pii.SemiCrf()
    model.w, model.t = r.normal(size=model.w.shape), r.normal(size=model.t.shape)
    toks = pii.tokens(text)
    every = list(segmentations(len(toks), pii.candidates(toks)))
    values = np.array([value(model, toks, s) for s in every])
    best = every[int(values.argmax())]
    assert model.best(toks) == [(k - 1, i, j) for i, j, k in best if k]
    gold = every[int(values.argmin())]
    ll, gw, gt = model.gradient(len(toks), model.arcs(toks), {s for s in gold if s[2]})
    assert ll == pytest.approx(values.min() - np.logaddexp.reduce(values))
    for at in [(0, 1), (1, 0), (2, 2)]:
        step = 1e-5
        model.t[at] += step
        up = np.array([value(model, toks, s) for s in every])
        model.t[at] -= step
        assert gt[at] == pytest.approx((up.min() - np.logaddexp.reduce(up) - ll) / step, abs=1e-3) or int(up.argmin()) != int(values.argmin())


def found(text):
    return {(pii.KINDS[k], text[a:b]) for k, a, b in pii.all_spans(pii.trained(), text, pii.base_spans(text))}


@pytest.mark.parametrize("text, span", [
    ("jane (at) " + "x" * 75 + " dot com", ("email", "jane (at) " + "x" * 75 + " dot com")), ("john at example dot org", ("email", "john at example dot org")),
    ("bob [at] site [dot] net", ("email", "bob [at] site [dot] net")), ("please call 555-123-4567 now", ("phone", "555-123-4567")),
])
def test_spans_beyond_the_patterns(text, span):
    assert span in found(text)


@pytest.mark.parametrize("text", ["look at example.com please", "at the dot of noon", "the year 2024 and 12 of 30", "dot com boom at the time", ""])
def test_plain_text_has_none(text):
    assert found(text) == set()


def test_precision_and_recall_of_added_spans_on_other_sentences():
    hit = want = got = 0
    for text, spans in pii.training_sentences(600, seed=99):
        base = set(pii.base_spans(text))
        gold, mine = set(spans) - base, set(pii.all_spans(pii.trained(), text, sorted(base))) - base
        hit, want, got = hit + len(gold & mine), want + len(gold), got + len(mine)
    assert hit / want >= 0.95 and hit / got >= 0.93, (hit, want, got)


def test_islands_hold_whole_words_and_every_trigger():
    r = np.random.default_rng(4)
    for _ in range(200):
        words = [str(r.choice(["word", "12", "a@b.c", "dot", "(at)", "x" * 50])) if r.random() < 0.2 else "plain" for _ in range(int(r.integers(0, 200)))]
        text = str(r.choice([" ", "  ", "\n"])).join(words)
        parts = list(pii.islands(text))
        for a, b in parts:
            assert (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b - 1].isspace())
            assert len(text[a:b].split()) <= len(text.split())
        assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
        hits = [m.start() for m in pii._TRIGGER.finditer(text)]
        assert all(any(a <= h < b for a, b in parts) for h in hits)
        for h in hits:  # the words on either side are in the same part
            a, b = next((a, b) for a, b in parts if a <= h < b)
            assert len(text[a:h].split()) >= min(pii.REACH - 1, len(text[:h].split())) and len(text[h:b].split()) >= min(pii.REACH, len(text[h:].split()))


def test_find_and_redact_with_clashing_columns_and_long_texts(spark):
    long = "plain words here " * 20_000 + "mail me: a.b@example.org " + "x1" * 30_000
    shape = "doc_id long, text string, n_email string, spans int, _in string"
    rows = [(1, long, "x", 1, "y"), (2, None, None, None, None), (3, "", "", 0, ""), (3, "call +1 212 555 0100", "", 0, ""), (3, "call +1 212 555 0100", "", 0, "")]
    docs = spark.createDataFrame(rows, shape)
    got = sorted(((r.doc_id, r.n_email, r.n_phone, r.spans) for r in pii.find_pii(docs).collect()), key=str)
    at = long.index("a.b@")
    assert (1, 1, 0) == got[0][:3] and f"email:{at}:{at + 15}" in got[0][3].split(",")
    assert got[1] == (2, 0, 0, "") and got[2] == (3, 0, 0, "") and got[3] == got[4] == (3, 0, 1, "phone:5:20")
    clean = {r.doc_id: r.text for r in pii.redact(docs.where("doc_id < 3 or text <> ''").dropDuplicates()).collect()}
    assert clean[2] is None and clean[3] == "call [phone]" and "a.b@" not in clean[1] and "mail me: [email] " in clean[1]
    assert pii.find_pii(spark.createDataFrame([], shape)).collect() == []
