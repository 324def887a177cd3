"""Operator 6, SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two link at 3 or fewer differing bits.  Cut into two segments of 32
bits, one segment of a linked pair differs by at most one bit.  Distinct fingerprints are
therefore indexed by each segment as it is and by each segment with one bit as a wildcard; an
equality join on these signatures finds every linked pair, and the whole fingerprints are compared.

Only signatures that can give a pair go on: two members at least, and for a wildcard both values
of its bit.  Large signatures are cut into blocks, and a task compares two blocks; what it returns
are links to the smallest fingerprint of each connected part of what it has compared, so a group
of m near copies gives links in proportion to m, not to its pairs.  Components come from
alternating large-star and small-star steps, which keep one minimum for each node.

Defined results: null or blank text: fingerprint zero, linked like any other; repeated rows and
ties: the same fingerprint; texts are read whole; no rows: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.components import connected
from loomweb.llm.shared import attach, checkpointed, table

MAX_DISTANCE, SHINGLE, SEED = 3, 3, 42
BLOCK = 4096
SHINGLES_AT_ONCE = 200_000
FINGERPRINTS_AT_ONCE = 50_000


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def bit_counts(hashes: list[int], counts: list[int]) -> np.ndarray:
    """For each run of hashes (none of them empty) how many have each of the 64 bits."""
    bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, np.concatenate(([0], np.cumsum(counts[:-1]))).astype(np.int64), axis=0, dtype=np.int64)


def packed(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints, as int64, of the bits that over half the hashes have."""
    return np.packbits(2 * sums > counts[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def fingerprints_of(texts) -> np.ndarray:
    """Hashes are counted SHINGLES_AT_ONCE at a time, those of one text too."""
    out, hashes, counts, places = np.zeros(len(texts), np.int64), [], [], []

    def flush() -> None:
        nonlocal hashes, counts, places
        if places:
            out[places] = packed(bit_counts(hashes, counts), np.array(counts))
        hashes, counts, places = [], [], []

    for place, text in enumerate(texts):
        found = shingle_hashes(text)
        if len(found) > SHINGLES_AT_ONCE:
            parts = [found[k : k + SHINGLES_AT_ONCE] for k in range(0, len(found), SHINGLES_AT_ONCE)]
            out[place] = packed(sum(bit_counts(p, [len(p)]) for p in parts), np.array([len(found)]))[0]
        elif found:
            hashes += found
            counts.append(len(found))
            places.append(place)
            if len(hashes) >= SHINGLES_AT_ONCE:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of that kind) and fp, the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _signatures(fps: DataFrame) -> DataFrame:
    """fp, which (0-65: each segment whole, then without each bit), signature and the wildcard's bit."""
    which = F.explode(F.sequence(F.lit(0), F.lit(65))).alias("which")
    rows = fps.select("fp", which)
    segment = F.when(F.col("which") % 2 == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    at = F.floor(F.col("which") / 2).cast("int") - 1
    mask = F.when(at < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, CAST(floor(which / 2) AS INT) - 1)"))
    rows = rows.select("fp", "which", segment.alias("segment"), mask.alias("mask"))
    return rows.select(
        "fp",
        (F.col("segment").bitwiseAND(F.bitwise_not("mask")) + F.col("which").cast("long") * (1 << 32)).alias("signature"),
        F.when(F.col("mask") == 0, None).otherwise((F.col("segment").bitwiseAND(F.col("mask")) != 0).cast("int")).alias("bit"),
    )


def compare(fps: np.ndarray, max_distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest of its connected part."""
    fps = np.unique(fps)
    near = [np.nonzero(np.bitwise_count(fps[i : i + 256, None] ^ fps[None, :]) <= max_distance) for i in range(0, len(fps), 256)]
    a = np.concatenate([r + 256 * i for i, (r, _) in enumerate(near)])
    b = np.concatenate([c for _, c in near])
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fps))
    return fps[label[moved]], fps[moved]


def _links_in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and blocks; compares the fingerprints of each run."""
    held: list[np.ndarray] = []
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        found = [compare(run) for run in np.split(fps, cuts)] if len(fps) else []
        src = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        dst = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], schema=schema)

    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy() for n in ("signature", "low", "high", "fp")], axis=1)
        held.append(rows)
        rows = np.concatenate(held)
        changed = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1))
        last = changed[-1] + 1 if len(changed) else 0  # the last run may go on in the next batch
        if last:
            yield links(rows[:last, :3], rows[:last, 3])
        held = [rows[last:]]
    if held and len(held[0]):
        yield links(held[0][:, :3], held[0][:, 3])


def link(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """src < dst: links that connect exactly the fingerprints (distinct, not null) that a chain of linked pairs connects."""
    # Adaptive execution makes few partitions of the small fingerprints; each row becomes 66 here.
    rows = _signatures(fps.repartition(max(1, -(-fps.count() // FINGERPRINTS_AT_ONCE), fps.sparkSession.sparkContext.defaultParallelism), "fp"))
    useful = (
        rows.groupBy("signature")
        .agg(F.count("*").alias("n"), F.min("bit").alias("least"), F.max("bit").alias("most"))
        .filter((F.col("n") > 1) & (F.col("least").isNull() | (F.col("least") != F.col("most"))))
        .select("signature", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # Spark sizes the rows as if the explode had added none (66 times too low) and would broadcast them.
    members = rows.select("signature", "fp").hint("merge").join(checkpointed(useful), "signature")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.select("signature", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("signature", F.least("own", "other").cast("long").alias("low"), F.greatest("own", "other").cast("long").alias("high"), "fp")
    runs = dealt.repartition("signature", "low", "high").sortWithinPartitions("signature", "low", "high")
    return runs.mapInArrow(_links_in_runs, "src long, dst long").distinct()


def classes_of(found: DataFrame) -> DataFrame:
    """found: doc_id, fp.  fp, n (its rows), root and component_id, the smallest doc_id that a chain of links reaches."""
    first = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = connected(link(first.select("fp")))
    of = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return checkpointed(of.select("fp", "n", "root").join(least, "root").select("fp", "n", "root", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id."""
    found = checkpointed(fingerprints(docs))
    return attach(found, classes_of(found), "fp", found.count()).select("doc_id", "fp", "component_id")


def key_digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, the one of the smallest doc_id (one without only where all are
    without), with the same columns.  Rows alike in doc_id and text count as one."""
    id_and_digest = F.struct(F.col("doc_id").cast("long").alias("doc_id"), key_digest().alias("digest"))
    found = fingerprints(docs.select(id_and_digest.alias("doc_id"), "text"), "struct<doc_id: long, digest: long>")
    found = checkpointed(found.select("doc_id.doc_id", "doc_id.digest", "fp"))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("low")
    classes = classes_of(found.select("doc_id", "fp")).select("fp", "n", "root")
    kept = attach(found, classes, "fp", found.count()).groupBy("root").agg(low)
    kept = kept.select(F.col("low.doc_id").alias("doc_id"), F.col("low.digest").alias("digest"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key_digest().alias("digest"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("rows.digest") == F.col("kept.digest"))
    return rows.alias("rows").join(kept.alias("kept"), same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
