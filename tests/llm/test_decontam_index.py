"""The rare-shingle index of the decontamination operator against all windows of all items, and its work on shared phrases."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from triagelake.llm import decontam as D
from triagelake.llm.common import blocks


def scan(items, texts):
    index = D.Items(list(range(len(items))), items)
    return sorted((a + r, *x) for a, _, data, offs in blocks(pa.array(texts, pa.large_string())) for r, *x in index.scan(data, offs))


def all_windows(items, texts):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = []
    for d, text in enumerate(texts):
        words = text.split()
        for k, item in enumerate(items):
            size, want = len(item.split()), bag(item.split())
            best = None
            for at in range(max(1, len(words) - size + 1)):
                have = bag(words[at : at + size])
                both = (want & have).total()
                sim = both / max(1, want.total() + have.total() - both)
                if sim >= D.SIMILARITY and (best is None or sim > best[0]):
                    best = (sim, at, min(size, len(words)))
            if best:
                out.append((d, k, *best))
    return out


@pytest.mark.parametrize("held", [1, 7, 1 << 19])
def test_equals_all_windows(held, monkeypatch):
    monkeypatch.setattr(D, "PAIRS", held)
    for seed in range(12):
        r = random.Random(seed)
        words = [f"a{i}" for i in range(r.choice((40, 400)))]
        items = [[r.choice(words) for _ in range(r.choice((30, 30, 45, 60)))] for _ in range(6)]
        items.append(items[0][:20] + items[1][:10])
        texts = []
        for _ in range(6):
            text = [r.choice(words) for _ in range(r.randrange(0, 80))]
            planted = list(r.choice(items))
            if r.random() < 0.6:
                planted[r.randrange(len(planted))] = "x"
            text[len(text) // 2 : len(text) // 2] = planted[r.randrange(3) :]
            texts.append(" ".join(text))
        items = [" ".join(i) for i in items]
        assert scan(items, texts) == all_windows(items, texts)


def test_a_phrase_that_many_items_share_costs_nothing(monkeypatch):
    r = random.Random(1)
    some = lambda n: " ".join(f"w{r.randrange(20000)}" for _ in range(n))
    opening = "in the beginning of this well known long text"
    items = [f"{opening} {some(41)}" for _ in range(4000)]
    text = " ".join(f"{opening} {some(12)}" for _ in range(200)) + f" {items[77]} {some(30)}"
    index = D.Items(list(range(len(items))), items)
    compared = []
    monkeypatch.setattr(D.Items, "_near", lambda self, bits, of, f=D.Items._near: compared.append(len(of)) or f(self, bits, of))
    start = time.process_time()
    ((_, _, data, offs),) = blocks(pa.array([text], pa.large_string()))
    got = index.scan(data, offs)
    assert [(k, sim) for _, k, sim, _, _ in got] == [(77, 1.0)]
    assert sum(compared) < 1000 and time.process_time() - start < 1


def test_window_prints_are_those_of_each_window():
    h = np.random.default_rng(3).integers(0, 1 << 63, 9000, dtype=np.uint64)
    places = np.unique(np.random.default_rng(4).integers(0, 8900, 500))
    places = np.concatenate([places[places < 2000], places[places > 2500]])
    got = D._window_prints(h, places, 40)
    assert all((got[i] == D.fingerprint(h[p : p + 40])).all() for i, p in enumerate(places.tolist()))
