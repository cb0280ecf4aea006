"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over threshold.

DataFrame functions only.  A line's key is the line stripped of blanks at both ends with A-Z lower-cased.
Keys of at least ``min_chars`` code points that stand in at least ``min_docs`` documents lose their lines
everywhere but in the largest doc_id holding them.

Edge cases: a null or empty text is one empty line; a null doc_id counts as one document that sorts first;
rows that share a doc_id are one document, so they count once and all keep or all lose a line; further
columns are carried through whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import SPACE_CHARS, ascii_lower, table, text_key

MIN_CHARS, MIN_DOCS, SALTS = 40, 5, 16


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row a (document, long key): hash, document and the positions of its lines."""
    lines = docs.select("_d", "_t", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_line", F.trim(F.col("_line"), F.lit(SPACE_CHARS))).where(F.length("_line") >= min_chars)
    return lines.select("_d", "_t", "_pos", F.md5(ascii_lower(F.col("_line"))).alias("_m")).select(
        F.unhex(F.substring("_m", 1, 32)).alias("_h"), "_d", "_t", "_pos"
    )


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_d, _t, _drop): for each row's content the positions of the lines it loses; rows that lose none are absent.

    Documents are counted in two steps, so a line that stands in a third of all documents reaches its last
    reducer as one partial sum a task; the join back is dealt by salted hashes.
    """
    lines = _lines(docs, min_chars)
    per_doc = lines.groupBy("_h", "_d").agg(F.lit(1).alias("_one"))
    often = (
        per_doc.groupBy("_h").agg(F.count("*").alias("_n"), F.max("_d").alias("_keep")).where(F.col("_n") >= min_docs)
        .select("_h", "_keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    return (
        lines.withColumn("_salt", F.pmod(F.xxhash64("_d", "_pos"), F.lit(SALTS)).cast("int"))
        .join(often, ["_h", "_salt"]).where(F.col("_d") != F.col("_keep"))
        .groupBy("_d", "_t").agg(F.collect_set("_pos").alias("_drop"))
    )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the new text, plus _n_lines and _n_dropped."""
    own = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_d"), text_key().alias("_t"), "text")
    drop = dropped_lines(own, min_chars, min_docs)
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    both = own.join(drop.hint("shuffle_hash"), ["_d", "_t"], "left")
    # a set difference of positions, in order and linear in the lines; the outer transform cuts the text once
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_drop"))
    rest = F.transform(F.array(split), lambda lines: F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(rest, F.lit(0)))
    return both.select(
        *[F.col("row")[c].alias(c) if c != "text" else kept.alias("text") for c in docs.columns if c not in ("_n_lines", "_n_dropped")],
        F.size(split).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


SQL = """
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, line, pos, often.k IS NOT NULL AND keep <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
