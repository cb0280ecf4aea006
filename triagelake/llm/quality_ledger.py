"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores measurements and failure bits.  A policy is a versioned mask:
``apply_policy`` keeps rows with no failed bit in the mask, ``ablation`` counts for every rule what the policy
would keep without it, from one aggregation over the masked bits (at most 2**rules groups).

Edge cases: a null or empty text has zero counts and fails ``few_words``; repeated rows each get their own
entry; further columns are carried, except the text and those named like a measurement or ``failed``, which are replaced
(``kept`` by ``apply_policy``); an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import IS_SPACE, blocks, distinct_ranges, leading, table, word_bounds

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rule name to failing condition, in the order of their bits. Integers only, so every engine agrees.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "10 * n_dup_lines > 6 * n_lines",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "strict-1": tuple(RULES),
}
DEFAULT_POLICY = "strict-1"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def mask_of(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether its (doc, key) stands more than once, and whether it is not the first."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    same = np.zeros(len(d) + 1, bool)
    same[1:-1] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    again, many = np.zeros(len(d), bool), np.zeros(len(d), bool)
    again[order] = same[:-1]
    many[order] = same[:-1] | same[1:]
    return many, again


def measure_block(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    starts, ends, doc = word_bounds(data, offs)
    solid = ~IS_SPACE[data]
    n_words = np.bincount(doc, minlength=n)
    chars = _sums(solid & ((data & 0xC0) != 0x80), offs)
    symbols = _sums(_SYMBOL[data], offs)
    # lines: cut at line feeds and at row ends
    cuts = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offs[:-1], cuts + 1]), kind="stable")
    stop = np.sort(np.concatenate([offs[1:], cuts]), kind="stable")
    words_to = np.concatenate([[0], np.cumsum(solid)])
    full = words_to[stop] > words_to[begin]
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(offs, begin, "right") - 1
    _, again = _repeats(line_doc, distinct_ranges(data, begin, stop)[1])
    n_lines = np.bincount(line_doc, minlength=n)
    dup_lines = np.bincount(line_doc[again], minlength=n)
    repeat = np.zeros(n, np.int64)
    if len(starts) > 2:
        word = distinct_ranges(data, starts, ends)[1]
        at = np.flatnonzero(doc[2:] == doc[:-2])
        pair = np.unique(word[at] << 32 | word[at + 1], return_inverse=True)[1]
        tri = pair << 32 | word[at + 2]
        many, _ = _repeats(doc[at], tri)
        hit = at[many]
        cover = np.zeros(len(starts), bool)
        cover[hit] = cover[hit + 1] = cover[hit + 2] = True
        repeat = np.bincount(doc[cover], minlength=n)
    return [n_words, chars, symbols, dup_lines, repeat, n_lines]


def measures(docs: DataFrame) -> DataFrame:
    """docs without its text, with the measurements: the text goes to Python once and not back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_block(data, offs) for _, _, data, offs in blocks(batch.column(0))]
            cols = [np.concatenate(c).astype(np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, cols)], names=[*batch.schema.names[1:], *MEASURES])

    rest = [c for c in docs.columns if c != "text" and c not in MEASURES]
    fields = "".join(f"`{c}` {t}, " for c, t in docs.select(*[F.col(f"`{c}`") for c in rest]).dtypes)
    return leading(docs, "text", rest).mapInArrow(run, fields + ", ".join(f"{m} bigint" for m in MEASURES))


def write_ledger(docs: DataFrame, path: str) -> DataFrame:
    """Stores the ledger of docs at path and reads it back: policies and ablations then touch no text."""
    ledger(docs).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def ledger(docs: DataFrame) -> DataFrame:
    """docs without its text, with measurements and ``failed``, the bits of the rules that a row fails."""
    bits = F.lit(0)
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measures(docs).withColumn("failed", bits.cast("long"))


def apply_policy(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """(rule, n_failed, n_failed_alone, n_kept_without): what each rule of the policy costs."""
    masked = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask_of(policy))).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = masked.withColumn("r", rules).select("m", "n", "r.*")
    has = F.col("m").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failed").bitwiseAND(F.lit(mask_of("base-1"))) != 0
    return kept.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM docs),
tri AS (
  SELECT r, p, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
rep AS (
  SELECT r, p, CASE WHEN w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 THEN 1 ELSE 0 END AS twice FROM tri),
cov AS (
  SELECT r, max(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM rep),
n_rep AS (SELECT r, sum(c)::BIGINT AS n_repeat_words FROM cov GROUP BY r),
n_dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN n_rep USING (r) LEFT JOIN n_dup USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words
    OR word_chars > 25 * n_words OR 10 * n_dup_lines > 6 * n_lines) AS kept
FROM m
"""
