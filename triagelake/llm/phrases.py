"""Phrase collocation mining by level-wise Apriori passes.

A text, A-Z lower-cased, is cut into pieces at PIECE_ENDS and a piece into words at blanks and tabs; a phrase is up
to ``longest`` neighbouring words of one piece, and all counts are per language.  Pass k reads the texts with the
broadcast frequent (k-1)-grams and emits a k-gram only where both of its (k-1)-grams are frequent; what is emitted is
counted exactly and kept from ``least`` occurrences on, as the level table of k.  Every part of a frequent phrase is
frequent, so the cuts of all phrases are scored from the level tables alone, without another pass.

The frequent grams travel as a bit table of two probes a gram, at most 2**MAX_BITS bits whatever the corpus: a gram
that is not frequent may pass it, which costs a row and changes no count.  Tasks add up what they emit by its bytes
before the shuffle, so a word pair that stands everywhere reaches its reducer as one row a task.  The first ``top``
rows of a language are found in SALTS shares first, so no task ranks a whole language.

Edge cases: a null text has no words, a null language is UNKNOWN; words and texts of any length are taken whole;
repeated rows count again; an empty table or one without frequent phrases gives no rows; other columns are not read.
Ties of equal score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.common import TO_LOWER, blocks, distinct_runs, mix, ragged, range_hashes, table, window_hashes
from triagelake.session import settled

LEAST, LONGEST, COVERED, TOP, UNKNOWN = 30, 4, 80, 2000, "und"
#: Bits of the table for each frequent gram, and the logarithms of its least and largest size.
BITS_A_GRAM, MIN_BITS, MAX_BITS = 16, 20, 30
#: Bytes of text that are counted at once, rows that are told apart by language at once, and the shares in which a language is ranked.
COUNT_BYTES, ROWS, SALTS = 1 << 20, 2048, 64
_BITMAP = 32768  # bits of a value of bitmap_construct_agg

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(PIECE_ENDS)] = 2


class Words:
    """The words of a block of texts: bytes with one blank behind each word, bounds, hashes, and the piece and row of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        kind = _KIND[data]
        solid = kind == 0
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        inner = offs[:-1]
        before[inner[inner < len(data)]] = False
        starts = np.flatnonzero(solid & ~before)
        ends = np.cumsum(kind == 2) if len(data) else np.zeros(0, np.int64)
        self.row = np.searchsorted(offs, starts, "right") - 1
        self.piece = ends[starts] + self.row
        last = np.flatnonzero(solid & ~np.append(solid[1:] & before[1:], False)) + 1 if len(data) else starts
        n = last - starts
        self.starts = np.cumsum(n + 1) - (n + 1)
        self.ends = self.starts + n
        self.data = np.full(int((n + 1).sum()), 32, np.uint8)
        self.data[ragged(self.starts, n)] = TO_LOWER[data[solid]]
        self.hashes = range_hashes(self.data, self.starts, self.ends)

    def text(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each position on, joined by one blank."""
        n = self.ends[at + k - 1] - self.starts[at]
        offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(self.data[ragged(self.starts[at], n)]))


def _of_lang(hashes: np.ndarray, lang: str) -> np.ndarray:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return mix(hashes ^ range_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bytes, offsets) of blocks of a batch (text, lang)."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        langs = part.column(1).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            text = part.column(0).filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == k)) if len(langs.dictionary) > 1 else part.column(0)
            for _, _, data, offs in blocks(text, COUNT_BYTES):
                if len(data) <= 2 * COUNT_BYTES:
                    yield lang, data, offs
                    continue
                # one long text: cut behind piece ends, over which no phrase goes
                ends, start = np.flatnonzero(_KIND[data] == 2) + 1, 0
                while start < len(data):
                    stop = np.append(ends, len(data))[np.searchsorted(ends, start + COUNT_BYTES)]
                    yield lang, data[start:stop], np.array([0, stop - start])
                    start = stop


class BitTable:
    """Which grams may be frequent: two bits for each."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.shift = bits, np.uint64(64 - log2)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        ok = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
        some = np.flatnonzero(ok)
        at = mix(h[some]) >> self.shift
        ok[some] = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return ok


def bit_table(level: DataFrame, k: int) -> tuple[bytes, int]:
    """The bits of a level table (lang, phrase of k words, f), and the logarithm of their number.

    Tasks set the bits of their rows; what comes to the driver is the table, 128 MB at most.
    """
    log2 = int(np.clip(np.ceil(np.log2(max(BITS_A_GRAM * level.count(), 1))), MIN_BITS, MAX_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data, offs in _by_lang(batch):
                w = Words(data, offs)
                h = _of_lang(window_hashes(w.hashes, k), lang)[np.searchsorted(w.row, np.arange(len(offs) - 1))]
                at = np.concatenate([h, mix(h)]) >> np.uint64(64 - log2)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    at = level.select("phrase", "lang").mapInArrow(run, "at bigint")
    got = at.groupBy(F.expr(f"at div {_BITMAP}").alias("k")).agg(F.bitmap_construct_agg(F.col("at") % _BITMAP).alias("m"))
    bits = np.zeros(max(1 << log2, _BITMAP) // 8, np.uint8)
    for r in got.toLocalIterator():
        bits[r.k * _BITMAP // 8 : (r.k + 1) * _BITMAP // 8] = np.frombuffer(r.m, np.uint8)
    return bits.tobytes(), log2


def level_counts(texts: DataFrame, k: int, known: tuple[bytes, int] | None) -> DataFrame:
    """(lang, phrase, f): exact counts of the k-grams whose (k-1)-grams may be frequent (of all words for k = 1).

    For k = 1 the row of the empty phrase has the number of a language's words.
    """
    sent = texts.sparkSession.sparkContext.broadcast(known) if known else None  # at most 2**MAX_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = BitTable(np.frombuffer(sent.value[0], np.uint8), sent.value[1]) if sent else None
        for batch in batches:
            for lang, data, offs in _by_lang(batch):
                w = Words(data, offs)
                at = np.flatnonzero(w.piece[: max(len(w.piece) - k + 1, 0)] == w.piece[k - 1 :])
                if table:
                    ok = table.has(_of_lang(window_hashes(w.hashes, k - 1), lang))
                    at = at[ok[at] & ok[at + 1]]
                if not len(at):
                    continue
                first, back = distinct_runs(w.data, w.starts[at], w.ends[at + k - 1], window_hashes(w.hashes, k)[at])
                n = np.bincount(back, minlength=len(first))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), w.text(at[first], k), pa.array(n)], names=["lang", "phrase", "f"])
                if k == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([len(at)])], names=["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the number of words, and the level tables (lang, phrase, f) of 1 to ``longest`` words, each written."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    words = settled(level_counts(texts, 1, None).where((F.col("f") >= least) | (F.col("phrase") == "")))
    levels = [words.where("phrase <> ''")]
    for k in range(2, longest + 1):
        levels.append(settled(level_counts(texts, k, bit_table(levels[-1], k - 1)).where(F.col("f") >= least)))
    return words.where("phrase = ''").select("lang", F.col("f").alias("n")), levels


def _union(levels: list[DataFrame]) -> DataFrame:
    out = None
    for k, level in enumerate(levels, 1):
        part = level.withColumn("words", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def scored_phrases(levels: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer one covers to ``covered`` percent.

    The score of a cut is floor(2000000 a / (l + r)) in exact decimals; the cut of the lowest counts, of equal ones
    the first.
    """
    every = _union(levels)
    cand = every.where("words > 1").withColumnRenamed("f", "a")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    part = lambda name, to: every.where(F.col("words") < len(levels)).select("lang", F.col("phrase").alias(name), F.col("f").alias(to))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    word = F.split("phrase", " ")
    spots = F.sequence(F.lit(0), F.col("words") - F.col("size"))
    inner = cand.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.select("lang", F.explode(F.transform(spots, lambda i: F.array_join(F.slice(word, i + 1, F.col("size")), " "))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * covered)).drop("longer")


def top_phrases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language with their rank, by score, a (both descending) and phrase."""
    keys = [(-F.col("score")).alias("s"), (-F.col("a")).alias("m"), F.col("phrase")]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*keys)
    near = scored.withColumn("at", F.row_number().over(share)).where(F.col("at") <= top)
    # at most top rows of each share, in one array a language
    best = near.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct(*keys, "l", "r"))), 1, top).alias("rows"))
    rows = best.select("lang", F.posexplode("rows").alias("at", "x"))
    return rows.select("lang", (F.col("at") + 1).cast("long").alias("rank"), "x.phrase", (-F.col("x.m")).alias("a"), "x.l", "x.r", (-F.col("x.s")).alias("score"))


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best collocations."""
    totals, levels = frequent_phrases(docs, least, longest)
    return top_phrases(scored_phrases(levels, covered), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = r"""
WITH low AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM low),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spots AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) AS ks(k)),
f AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM spots GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, size, w, f AS a, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes AS (SELECT lang, w, f, size, s FROM cand, range(2, 4) AS ss(s) WHERE s < size),
starts AS (SELECT lang, w, f, s, unnest(range(1, size - s + 2)) AS i FROM sizes),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer FROM starts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase)
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
