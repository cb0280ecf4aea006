"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint takes the majority of each bit over the XXH64 (seed 42) of its word shingles, repeats
included.  Every distinct fingerprint emits all variants within half the radius; fingerprints at a distance
within the radius share a variant, so one shuffle on variants finds every link.  What meets on a variant lies
within the radius, and the distance is verified; links run to the group's smallest fingerprint, which keeps
the reachable sets and emits no pairs within a group.  Exact copies collapse before the shuffle.

Edge cases: a null text has no words and fingerprint zero, and links like any other; fewer words than a
shingle make one shingle of all words; a null doc_id sorts after all others, so it names a component only
alone; repeated rows each come out; further columns are carried by ``keep_one``; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import blocks, checkpoint, table
from triagelake.llm.graph import components

SEED, BITS = 42, 64
NO_ID = 2**63 - 1


def fingerprint_of(text: bytes, width: int) -> int:
    """The fingerprint of one text; its words are those between blanks, with A-Z lower-cased."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(len(w) - width + 1, 1)
    parts = [w[i : i + n] for i in range(min(width, len(w)))]
    h = np.fromiter(map(_hash, map(b" ".join, zip(*parts))), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def fingerprints(docs: DataFrame, width: int = 3, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and fp long, the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for a, b, data, offs in blocks(batch.column("_text")):
                raw = data.tobytes()
                fps += [fingerprint_of(raw[offs[i] : offs[i + 1]], width) for i in range(b - a)]
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*batch.schema.names[1:], "fp"])

    src = docs.select(F.col("text").alias("_text"), *columns)
    fields = ", ".join(f"`{c}` {t}" for c, t in src.drop("_text").dtypes)
    return src.mapInArrow(run, f"{fields}, fp bigint")


def variants(fp, radius: int):
    """Array of all 64-bit words within half the radius of fp."""
    if radius % 2:
        raise ValueError("the radius must be even: at an odd one, fingerprints that meet may be farther apart than the radius")
    masks, rings = {0}, radius // 2
    for _ in range(rings):
        masks |= {m ^ (1 << b) for m in masks for b in range(BITS)}
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in sorted(masks)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): fingerprints of the frame linked within the radius, each group tied to its smallest one."""
    balls = fps.select("fp", F.explode(variants(F.col("fp"), radius)).alias("v"))
    groups = balls.groupBy("v").agg(F.collect_list("fp").alias("of")).where(F.size("of") > 1)  # distinct, so a ball's size bounds it
    pairs = groups.select(F.array_min("of").alias("a"), F.explode("of").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns with fp and component (smallest doc_id reachable over links)."""
    marked = fingerprints(docs, width, columns)
    marked = checkpoint(marked)
    first = marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"))
    # each fingerprint becomes a row a variant, so these few bytes are dealt to all tasks first (by a hash of the
    # fingerprint: by itself they are dealt already, in the few tasks that their bytes are worth)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = components(links(first.select("fp").repartition(parts, F.xxhash64("fp")), radius))
    named = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    by_fp = named.join(least, "root").select("fp", "component")
    return marked.join(by_fp, "fp")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") == NO_ID, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays (of equal ids one).

    Ties among rows of the smallest doc_id go to the smallest text hash.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").withColumn("k", F.xxhash64("row"))
    found = near_duplicates(rows, width, radius, ("doc_id", "k"))
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "k")).alias("m")).select("m.*").distinct()
    return rows.join(best.hint("shuffle_hash"), ["doc_id", "k"], "left_semi").dropDuplicates(["doc_id", "k"]).select("row.*")
