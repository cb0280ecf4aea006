"""Blocks of text hold the same rows in the same order, however a shuffle delivers them."""

import numpy as np
import pytest

from triagelake.llm import substring_dedup, suffix_dedup


@pytest.mark.parametrize("module, name", [(suffix_dedup, "_segments"), (substring_dedup, "_extend")])
def test_blocks_are_packed_in_the_order_of_their_rows(spark, monkeypatch, module, name):
    pack = getattr(module, name)

    def ordered(*args):
        run = pack(*args)

        def checked(batches):
            last = None

            def watch():
                nonlocal last
                for batch in batches:
                    for at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                        assert last is None or last <= at, "rows of a block follow the shuffle's delivery"
                        last = at
                    yield batch

            yield from run(watch())

        return checked

    monkeypatch.setattr(module, name, ordered)
    r = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(500)]
    passage = " ".join(r.choice(vocab, 80))
    rows = [(int(d), f"{' '.join(r.choice(vocab, 20))} {passage}") for d in r.permutation(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _, spans = module.removed_spans(docs)
    assert spans.count() == 59
