import hashlib

import numpy as np
from triagelake.llm import suffix_dedup
from triagelake.llm.lyndon_sa import suffix_arrays

SCHEMA = "doc_id long, text string"


def brute(rows, length=100):
    """Removed byte spans by looking up every window; rows of one doc_id are not smaller than each other."""
    texts = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in texts:
        gone, seen = np.zeros(len(t), bool), set()
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if least[w] < d or w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((None if d == 2**63 - 1 else d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA + ", d int, spans int").repartition(3)
    out = suffix_dedup.suffix_dedup(df).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=repr)


def corpus(seed=1, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé "), rng.integers(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(40) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [prose(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(4))]
            cut = int(rng.integers(0, 60))
            parts += [s[cut : cut + int(rng.integers(90, 260))], prose(int(rng.integers(0, 10)))]
        rows.append((i, "\n".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a" * 700), (103, "ab" * 300), (104, "a" * 99), (105, "a" * 100)]
    return rows


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(3)
    for _ in range(60):
        strings = [np.append(rng.integers(1, rng.integers(2, 5), rng.integers(0, 40)), 0) for _ in range(rng.integers(1, 5))]
        begin = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        sa = suffix_arrays(np.concatenate(strings).astype(np.int64), begin)
        for b, s in zip(begin, strings):
            assert (sa[b : b + len(s)] - b).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_removes_what_brute_force_removes(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_hot_anchors_and_small_blocks(spark, monkeypatch):
    rows = corpus(2, 40)
    docs = spark.createDataFrame(rows, SCHEMA)
    for hot, segments, pack in ((1, 2, 900), (1 << 30, 2, 4000), (2, 32, 700)):
        monkeypatch.setattr(suffix_dedup, "MAX_SEGMENTS", segments)
        assert run_local(rows, hot, pack, monkeypatch) == brute(rows)
    assert docs.count() == len(rows)


def run_local(rows, hot, pack, monkeypatch):
    """The operator's own task functions, called here so that small limits hold in them."""
    import types

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", pack)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: types.SimpleNamespace(partitionId=lambda: 5)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t for _, t in rows]), pa.array([d for d, _ in rows], pa.int64()), pa.array(range(len(rows)), pa.int64())], names=["text", "d", "t"]
    )

    def grouped(batches, fn):
        t = pa.Table.from_batches(batches, suffix_dedup._SCHEMA) if isinstance(batches, list) else batches
        keys = sorted(set(t.column("key").to_pylist()))
        import pyarrow.compute as pc

        return [fn(t.filter(pc.equal(t.column("key"), k))) for k in keys]

    met = grouped(list(suffix_dedup._probe(8, 100)(iter([batch]))), suffix_dedup._repeated)
    starts = pa.concat_tables(grouped(pa.concat_tables(met), suffix_dedup._starts)).to_pylist()
    by_row = {x["t"]: x["starts"] for x in starts}
    of = sorted(by_row)
    if not of:
        return [(d, len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    found = pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(of, pa.int64())), batch.column(1).take(pa.array(of, pa.int64())), pa.array(of, pa.int64()), pa.array([by_row[i] for i in of], pa.binary())], names=["text", "d", "t", "starts"]
    )
    runs = grouped(list(suffix_dedup._segments(8, 100)(iter([found]))), suffix_dedup._classes(100))
    spans = {x["t"]: np.frombuffer(x["spans"], np.int64).reshape(-1, 2) for x in pa.concat_tables(grouped(pa.concat_tables(runs), suffix_dedup._spans(100))).to_pylist()}
    out = []
    for i, (d, t) in enumerate(rows):
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for a, b in spans.get(i, []):
            gone[a:b] = True
        out.append((d, len(raw), int(gone.sum()), len(spans.get(i, [])), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def test_edge_cases(spark):
    long = "xyz " * 30 + "q" * 50
    rows = [(None, long), (7, long), (7, long), (8, None), (9, ""), (7, "other " + long), (None, long + "!")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
