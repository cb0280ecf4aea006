"""Documents shorter than a benchmark item against brute force over whole documents and windows."""

from collections import Counter

import numpy as np

from triagelake.llm import decontam


def best(t, item):
    """(similarity, first word, words) of the best window; a shorter document is its one window."""
    a, b = t.split(), item.split()
    k = min(5, len(b))
    bag = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want, top = bag(b), (0.0, 0, 0)
    for i in range(max(len(a) - len(b), 0) + 1):
        w = a[i : i + len(b)]
        sim = sum((want & bag(w)).values()) / sum((want | bag(w)).values())
        if sim > top[0]:
            top = (sim, i, len(w))
    return top


def test_documents_shorter_than_the_item(spark):
    r = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab, n))) for i, n in enumerate([50, 59, 30, 50, 4, 9])]
    docs = []
    for i, t in items:
        w = t.split()
        for cut in range(0, 14):
            docs += [(100 * i + cut, " ".join(w[: len(w) - cut])), (100 * i + 50 + cut, " ".join(w[cut:]))]
        docs.append((100 * i + 90, " ".join(r.choice(vocab, len(w) - 1))))
    docs += [(901, None), (902, ""), (903, "one two " + items[0][1] + " three")]
    want = {}
    for d, t in docs:
        for i, x in items:
            sim, at, n = best(t or "", x)
            if sim >= 0.8:
                want[d, i] = (round(sim, 9), at, n)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (round(x.similarity, 9), x.start_word, x.n_words) for x in decontam.find_leaks(frame, bench).collect()}
    assert got == want and want[1, 0] == (round(45 / 46, 9), 0, 49)
    left = decontam.remove_leaks(frame, bench).collect()
    assert sorted(x.doc_id for x in left) == sorted({d for d, _ in docs} - {d for d, _ in want})
