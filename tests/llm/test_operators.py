"""Each operator against a brute-force version, a library or planted cases, with nulls, empties, repeats and clashing columns."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
import xxhash

from triagelake.llm import decontam, html_extract, line_dedup, pii, piece_codec, quality_ledger, queries, simhash_dedup, substring_dedup, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def frame(spark, rows):
    """Rows with columns named like the operators' own."""
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, d int, fp string, _n_lines int").repartition(3)


def corpus(seed=5, n=40):
    r = np.random.default_rng(seed)
    vocab = ["".join(r.choice(list("abcdefghé"), r.integers(1, 8))) for _ in range(80)]
    prose = lambda k: " ".join(r.choice(vocab, k))
    passages = [prose(70) for _ in range(3)]
    lines = [prose(12) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [prose(int(r.integers(0, 60)))]
        if i % 3 == 0:
            parts.append(passages[i % 9 // 3][int(r.integers(0, 40)) :])
        if i % 4 == 0:
            parts.append("  " + lines[i % 12 // 4].upper() + "\t")
        rows.append((i, "\n".join(parts)))
    return rows + [(50, None), (51, ""), (52, " \n\t"), (3, rows[3][1]), (60, rows[3][1]), (61, rows[3][1] + " tail"), (None, passages[0]), (70, "word " * 3000)]


def test_substring_dedup_against_brute_force(spark):
    rows, least = corpus(), {}
    words = [(2**63 - 1 if d is None else d, re.findall(WORD, t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            least[k] = min(d, least.get(k, d))
    want = []
    for d, w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = True
        want.append((None if d == 2**63 - 1 else d, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rows = corpus()
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(-1 if d is None else d)
    want = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == (-1 if d is None else d)]
        want.append((d, len(ls), len(ls) - len(keep), "\n".join(keep)))
    got = line_dedup.line_dedup(frame(spark, rows))
    assert set(got.columns) >= {"doc_id", "text", "d", "fp"}
    got = [(r.doc_id, r._n_lines, r._n_dropped, r.text) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def naive_fingerprint(t, width=3):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(len(w) - width + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_against_brute_force(spark):
    rows = [(d, t) for d, t in corpus() if d is not None]
    base = "one two three four five six seven eight nine ten " * 30
    rows += [(200 + i, base + " ".join(f"w{j}" for j in range(i))) for i in range(12)]
    fps = [naive_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))
    found = simhash_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, f"{r.fp % 2**64:016x}", r.component) for r in found) == want
    kept = simhash_dedup.keep_one(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    assert simhash_dedup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_with_null_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "z y x w v"), (6, None), (6, None)]
    got = sorted(((r.doc_id, r.component) for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (None, simhash_dedup.NO_ID), (6, 6), (6, 6)], key=repr)


def test_decontamination_finds_planted_items_only(spark):
    r = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(r.choice(vocab, int(n)))) for i, n in enumerate(r.integers(20, 90, 12))] + [(90, None), (91, "..."), (92, items_short := "just three words")]
    edit = items[4][1].split()
    edit[len(edit) // 2] = "changed"
    docs = [(i, " ".join(r.choice(vocab, 80))) for i in range(20)]
    docs += [(100, f"{docs[0][1]} {items[2][1].upper()}! {docs[1][1]}"), (101, " ".join(edit)), (102, items_short), (103, None), (104, ""), (100, "clean now")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sh = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    def best(t, item):
        norm = lambda s: re.sub(r"[!-/:-@\[-`{-~]", "", (s or "").lower()).split()
        from collections import Counter

        a, b = norm(t), norm(item)
        if not b:
            return 0.0
        k, top = min(5, len(b)), 0.0
        want = Counter(sh(b, k))
        for i in range(len(a) - len(b) + 1):
            have = Counter(sh(a[i : i + len(b)], k))
            top = max(top, sum((want & have).values()) / sum((want | have).values()))
        return top

    want = sorted({(d, i) for d, t in docs for i, x in items if best(t, x) >= 0.8})
    found = decontam.find_leaks(frame(spark, docs), bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in found) == want and (100, 2) in want and (102, 92) in want
    left = decontam.remove_leaks(frame(spark, docs), bench).collect()
    assert len(left) == len(docs) - sum(any(best(t, x) >= 0.8 for _, x in items) for _, t in docs)
    assert decontam.find_leaks(frame(spark, docs), bench.limit(0)).count() == 0


def naive_spans(t):
    def hits(pattern, ok):
        return [m.span() for m in re.finditer(pattern, t) if ok(m.group())]

    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = digits(s)[::-1]
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(d)) % 10 == 0

    return [
        ("email", hits(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)),
        ("ip", hits(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))),
        ("card", hits(r"[0-9]([\x20-]?[0-9])+", luhn)),
        ("phone", hits(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)),
    ]


def test_base_pii_spans_against_the_patterns(spark):
    rows = corpus() + [
        (300, "mail a.b+c@x-y.co.uk, é@b.de or @c.d. ip 10.0.0.255 and 1.2.3.4.5.6.7.8 or 256.1.1.1"), (301, "card 4111 1111 1111 1111 and 4111-1111-1111-1112; call +44 (0)20 7946-0958 now"),
        (302, "a@b@c.com x@y.z..w +1 2 +123456789"), (303, "1.2.3.4 5.6.7.8" * 50), (304, "write jane (at) example (dot) org"), (305, "é" * 10 + " q@é.com w@w.w"),
    ]
    want = []
    for d, t in rows:
        s = naive_spans(t or "")
        want.append((d, *[len(x) for _, x in s], sha(",".join(f"{k}:{a}:{b}" for k, x in s for a, b in x))))
    got = pii.find_pii(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert pii.find_pii(frame(spark, rows).limit(0)).count() == 0


def test_piece_codec_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rows = corpus() + [(400, "Ünïcode ﬁ 漢字 ​😀  two  blanks \x00 <s> </s> <unk>"), (401, "a" * 5000), (402, "  lead and trail  \n\n"), (403, "▁▁ x ▁")]
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.digests(frame(spark, rows).select("doc_id", "text")).collect()), key=repr)
    want = []
    for d, t in rows:
        ids = lib.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert got == sorted(want, key=repr)
    assert piece_codec.digests(frame(spark, rows).limit(0).select("doc_id", "text")).count() == 0


def test_toxicity_on_held_out_labels(spark):
    out = toxicity.op8_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(bad) > 0.5 and np.mean(good) < 0.03  # part of the labels is noise: no text could tell
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.trained_model(docs.select("doc_id", "text"), labels)
    edge = toxicity.score(frame(spark, [(1, None), (1, ""), (None, "fine words")]), model).collect()
    assert len(edge) == 3 and all(0 <= r.score < 0.5 for r in edge)
    assert toxicity.score(frame(spark, [(1, "x")]), toxicity.trained_model(docs.select("doc_id", "text"), labels.limit(0))).count() == 1


def test_html_extraction(spark):
    body = "".join(f"<p>This is paragraph {i} of the article, with enough plain words to read like prose &amp; more.</p>\n" for i in range(6))
    page = f"<html><head><style>p{{}}</style><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><article><h1>A title of the page</h1>{body}</article><footer>Copyright 2024 Example</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, 0), (2, "v", None, 0), (3, "w", "", 0), (4, "x", "<div", 0)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
    assert "prose & more." in got[1] and got[1].count("\n") >= 5 and "Copyright" not in got[1] and "About" not in got[1] and "var x" not in got[1]
    assert got[2] == got[3] == "" and set(got) == {1, 2, 3, 4}


def test_quality_ablation(spark):
    entries = quality_ledger.ledger(frame(spark, corpus()))
    rows = entries.select("failed").collect()
    for r in quality_ledger.ablation(entries).collect():
        bit = quality_ledger.BIT[r.rule]
        assert r.n_failed == sum(bool(x.failed & bit) for x in rows)
        assert r.n_kept_without == sum(not x.failed & ~bit for x in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SMALL).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = pipeline.run(spark, SMALL).collect()
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) <= docs.count() and len(set(ids)) == len(ids)
    # stage by stage: what each stage removes is what its own operator says
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, at, SMALL)
        rows = after.collect()
        assert after.columns == docs.columns, name
        at = spark.createDataFrame(rows, docs.schema)
    assert sorted(r.doc_id for r in at.collect()) == sorted(ids)
