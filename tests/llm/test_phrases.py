"""Phrase mining against brute force, with few and with saturated bits, and its exact scores."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import phrases

SHAPE = "doc_id long, text string, lang string, extra string"


def brute(rows, least, longest, covered, top):
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(100 * b >= covered * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cand.items() if x == lang):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def made(seed, n=60):
    r = np.random.default_rng(seed)
    words = ["the", "The", "of", "New", "york", "City", "é", "ß-x", "a\xa0b", "x" * 300, "#", "zz"]
    seps = [" ", "  ", "\t", ". ", ",", "\n", "; ", " ", " ", "\r\n", "\x0b"]
    rows = [(i, "".join(r.choice(words) + r.choice(seps) for _ in range(r.integers(0, 60))), [None, "en", "fr", ""][r.integers(0, 4)], "e") for i in range(n)]
    return rows + [(100, None, "en", None), (None, "", None, None), (101, " \t\n.", "xx", None), (102, "new york city " * 40, "en", None), (102, "new york city " * 40, "en", None)]


@pytest.mark.parametrize("seed, bits", [(1, 20), (2, 3)])
def test_equals_brute_force_whatever_passes_the_bits(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(phrases, "MAX_BITS", bits)  # at 3 bits every gram passes
    monkeypatch.setattr(phrases, "MIN_BITS", min(bits, 10))
    monkeypatch.setattr(phrases, "COUNT_BYTES", 700)
    rows = made(seed)
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    got = phrases.mine_phrases(docs, 4, 4, 80, 25)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 4, 80, 25)


def test_bits_prune_what_is_not_frequent(spark):
    rows = made(3)
    texts = spark.createDataFrame(rows, SHAPE).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words = phrases.level_counts(texts, 1, None)
    known = phrases.bit_table(words.where("f >= 40 and phrase <> ''"), 1)
    often = {(r.lang, r.phrase) for r in words.where("f >= 40 and phrase <> ''").collect()}
    all_pairs = phrases.level_counts(texts, 2, phrases.bit_table(words.where("phrase <> ''"), 1)).collect()
    kept = {tuple(r) for r in phrases.level_counts(texts, 2, known).collect()}
    assert kept == {tuple(r) for r in all_pairs if all((r.lang, w) in often for w in r.phrase.split(" "))} and 0 < len(kept) < len(all_pairs)


def test_scores_past_64_bits_and_ties(spark):
    big = 2**60
    one = spark.createDataFrame([("en", w, n) for w, n in (("a", big), ("b", big), ("c", 3), ("d", 3), ("e", 3))], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "a b", big), ("en", "c d", 3), ("en", "d e", 2)], "lang string, phrase string, f long")
    three = spark.createDataFrame([("en", "c d e", 2)], "lang string, phrase string, f long")
    got = {r.phrase: r for r in phrases.top_phrases(phrases.scored_phrases([one, two, three])).collect()}
    # "d e" is covered; of the cuts of "c d e" the first has 4000000 // (3 + 2), the second 4000000 // (3 + 3)
    assert set(got) == {"a b", "c d", "c d e"} and got["a b"].score == 1_000_000 == got["c d"].score
    assert (got["c d e"].l, got["c d e"].r, got["c d e"].score) == (3, 3, 666_666)
    assert [got[p].rank for p in ("a b", "c d", "c d e")] == [1, 2, 3]


def test_a_long_text_is_cut_behind_piece_ends(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "COUNT_BYTES", 50)
    text = "one two three. " * 40 + "no end here " * 30 + "x, y" + "," * 120
    batch = pa.RecordBatch.from_arrays([pa.array([text, "short", None]), pa.array(["en", "en", "en"])], names=["text", "lang"])
    parts = [data.tobytes().decode() for _, data, offs in phrases._by_lang(batch)]
    assert "".join(parts) == text + "short" and len(parts) > 8
    assert all(p[-1] in ".," for p in parts[: len(parts) - 1] if p != parts[-2]) and max(map(len, parts)) < 420


def test_no_rows_from_nothing(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], SHAPE)).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([(1, None, None, "x"), (2, "few words", "en", "x")], SHAPE)).collect() == []
