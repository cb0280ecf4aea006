"""Ranges are equal by their bytes: words whose sums of powers agree modulo 2**64 stay apart everywhere."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from triagelake.llm import common, decontam, piece_codec, quality_ledger, substring_dedup


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "ba")) for n in (1024, 4096)]


@pytest.mark.parametrize("one, other", PAIRS)
def test_hashes_differ(one, other):
    data = np.frombuffer((one + other).encode(), np.uint8)
    n = len(one)
    assert len(set(common.range_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    letters = np.frombuffer(thue_morse(64).encode() + thue_morse(64, "ba").encode(), np.uint8)
    assert len(set(common.range_hashes(letters, np.array([0, 64]), np.array([64, 128])).tolist())) == 2


def test_window_hashes_are_equal_exactly_for_equal_windows():
    r = np.random.default_rng(3)
    h = r.integers(0, 3, 4000).astype(np.uint64)
    for width in (1, 2, 3, 5, 25, 50):
        got = common.window_hashes(h, width)
        windows = [h[i : i + width].tobytes() for i in range(len(h) - width + 1)]
        assert len(got) == len(windows)
        assert len(set(zip(windows, got.tolist()))) == len(set(windows)) == len(set(got.tolist()))
    assert len(common.window_hashes(h[:3], 4)) == 0


@pytest.mark.parametrize("blind", [False, True], ids=["own hash", "all hashes equal"])
def test_distinct_ranges_go_by_bytes(monkeypatch, blind):
    if blind:
        monkeypatch.setattr(common, "range_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in r.integers(0, 12, 300)] + [b"x" * 500, b"x" * 500, b"x" * 499 + b"y", b"", b"x" * 70, b"x" * 70]
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    first, back = common.distinct_ranges(data, end - [len(t) for t in texts], end)
    assert len(first) == len(set(texts))
    assert [texts[first[k]] for k in back] == texts


@pytest.mark.parametrize("one, other", PAIRS)
def test_piece_codec_is_the_library(one, other):
    sentencepiece, public_tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = f"{one} {other} {one}"
    with open(path, "rb") as f:
        p = piece_codec.pieces_of(f.read())
    ids, counts = piece_codec.encode_block(p, [text.encode()])
    assert ids.tolist() == sp.encode(text)
    assert piece_codec.decode_block(p, ids, counts) == [text.encode()]


@pytest.mark.parametrize("one, other", PAIRS)
def test_quality_counts_agree_with_sql(spark, tmp_path, one, other):
    docs = pd.DataFrame({"doc_id": [1, 2, 3], "text": [f"{one}\n{other}\n{one}", f"{one} {other} {one} {other} x", f"{one} a b {other} a b"]})
    docs.to_parquet(tmp_path / "documents.parquet")
    got = quality_ledger.op9_quality_ledger(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    duckdb.register("documents", docs)
    want = duckdb.sql(quality_ledger.SQL).df().sort_values("doc_id")
    assert got[want.columns].values.tolist() == want.values.tolist()


@pytest.mark.parametrize("one, other", PAIRS)
def test_substring_dedup_keeps_other_words(spark, one, other):
    around = [f"w{i}" for i in range(60)]
    a, b = around[:30] + [one] + around[30:], around[:30] + [other] + around[30:]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 61}


@pytest.mark.parametrize("one, other", PAIRS)
def test_decontamination_keeps_other_words(one, other):
    items = decontam.Items([1], [" ".join([one] * 8)])
    text = np.frombuffer(" ".join([other] * 8).encode(), np.uint8)
    assert items.scan(text, np.array([0, len(text)])) == []
    text = np.frombuffer(" ".join([one] * 8).encode(), np.uint8)
    assert [(r, k, s) for r, k, s, *_ in items.scan(text, np.array([0, len(text)]))] == [(0, 0, 1.0)]
