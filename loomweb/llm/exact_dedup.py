"""Operator 11, exact duplicates by a minimal perfect hash over the distinct digests seen so far.

Texts are equal when they are identical without ASCII white space; a text's digest is SHA-256 of what is left.
An index keeps the digests of earlier texts in buckets by their first bits.  A bucket has a minimal perfect hash:
levels of bits in which a digest takes the first place that no other one of its level wants, and whose rank among
the set bits is its slot, so that n digests have the slots 0 to n-1 and about three bits each.  A slot holds
the full digest, the locator of the winner (doc_id and size) and how many rows share the text.

A perfect hash gives strangers a slot too, so each lookup compares all bytes of the digest.  Members of an
arriving batch are repeats: they change their slot's winner and count.  Nonmembers group among themselves, and
the bucket's hash is built anew with them, which makes the batch part of the history of the next one.

Arrivals are grouped by digest before they are dealt out, combined before the shuffle, so a bucket gets each text once.
Single rows then look up their slot.  A bucket with many rows is dealt out in parts, each with a copy of its
index row, so copies of one text spread over tasks; such buckets are fewer than HOT_SHARE, whatever the number of rows.
A bucket has about KEYS_PER_BUCKET digests; where an index outgrows that, it is dealt out by more bits.

Of equal texts the one with the most code points stays, of these the smallest doc_id.

Defined results: null text: empty, equal to any text of white space alone; null doc_id: after all others; rows alike
in doc_id and size of text: one locator, all of them stay; texts are read whole; no rows: no rows; extra
columns are ignored by digested(), kept by keep_one(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.shared import HOT_SHARE, checkpointed, new_folder, remove, table

KEYS_PER_BUCKET, ROWS_PER_TASK = 4096, 16384
MAX_BITS = 32
PLACES_PER_KEY = 1.3
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BUCKET = "bucket long, sizes array<int>, bits binary, digests binary, ids array<long>, chars array<long>, counts array<long>"


def words_of(digests: pa.ChunkedArray) -> np.ndarray:
    """Four words for each digest."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """bits: those of all levels; sizes: how many of them belong to each level."""
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - 1

    @staticmethod
    def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(words), level + 1, np.uint64)
        for k in range(4):
            h = (h ^ words[:, k]) * _ODD[k]
            h ^= h >> np.uint64(29)
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        """words: of distinct digests."""
        if len(np.unique(words, axis=0)) < len(words):
            raise ValueError("a digest occurs twice")
        sizes, levels = [], []
        while len(words):
            size = int(len(words) * PLACES_PER_KEY) + 1
            place = cls.places(words, len(sizes), size)
            wanted = np.bincount(place, minlength=size)
            sizes.append(size)
            levels.append(wanted == 1)
            words = words[wanted[place] > 1]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Each member's own slot; for others any slot, or -1."""
        out, open_, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = start + self.places(words[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_, start = open_[~hit], start + size
        return out


@dataclass
class Entries:
    """Digests (distinct), their winners and their numbers of rows."""

    words: np.ndarray
    ids: np.ndarray
    has_id: np.ndarray
    chars: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, ids: pa.Array, chars: pa.Array, counts: pa.Array) -> Entries:
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return cls(words, ids.fill_null(0).to_numpy(zero_copy_only=False).copy(), ids.is_valid().to_numpy(zero_copy_only=False), np.array(chars), np.array(counts))

    def __getitem__(self, rows: np.ndarray) -> Entries:
        return Entries(self.words[rows], self.ids[rows], self.has_id[rows], self.chars[rows], self.counts[rows])

    def __add__(self, other: Entries) -> Entries:
        return Entries(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("words", "ids", "has_id", "chars", "counts")))

    def take(self, slots: np.ndarray, other: Entries) -> None:
        """other's rows are repeats of the slots' texts."""
        own = self[slots]
        by_id = np.where(other.has_id != own.has_id, other.has_id, other.ids < own.ids)
        wins = np.where(other.chars != own.chars, other.chars > own.chars, by_id)
        for n in ("ids", "has_id", "chars"):
            getattr(self, n)[slots[wins]] = getattr(other, n)[wins]
        self.counts[slots] += other.counts


class Bucket:
    def __init__(self, entries: Entries, hashed: PerfectHash | None = None):
        """entries in the order of their slots, or in any order without a hash, which is then built."""
        self.hashed = hashed or PerfectHash.of(entries.words)
        self.entries = entries if hashed else entries[np.argsort(self.hashed.slots(entries.words))]

    @classmethod
    def read(cls, row: pa.Table) -> Bucket | None:
        """From an index row, if there is one."""
        if not row.num_rows:
            return None
        get = lambda n: row.column(n)[0]
        sizes = np.array(get("sizes").as_py(), np.int64)
        bits = np.unpackbits(np.frombuffer(get("bits").as_py(), np.uint8), count=int(sizes.sum())).astype(bool)
        words = np.frombuffer(get("digests").as_py(), np.uint64).reshape(-1, 4)
        return cls(Entries.of(words, get("ids").values, get("chars").values, get("counts").values), PerfectHash(sizes, bits))

    def row(self, bucket: int) -> pa.Table:
        e = self.entries
        values = {
            "bucket": pa.array([bucket], pa.int64()),
            "sizes": pa.array([self.hashed.sizes], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(self.hashed.bits).tobytes()]),
            "digests": pa.array([e.words.tobytes()]),
        }
        for name, column in (("ids", pa.array(e.ids, mask=~e.has_id)), ("chars", pa.array(e.chars)), ("counts", pa.array(e.counts))):
            values[name] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        return pa.table(values)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each digest and whether all its bytes stand there."""
        slots = self.hashed.slots(words)
        member = slots >= 0
        member[member] = np.all(self.entries.words[slots[member]] == words[member], axis=1)
        return slots, member


@dataclass
class Index:
    """A row for each bucket, dealt out by the first bits of a digest; path: where it is stored."""

    rows: DataFrame
    bits: int
    path: str


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points of the text) and digest (of the text without white space), a row for each of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            digests = [hashlib.sha256(t.encode().translate(None, _SPACE)).digest() for t in texts]
            made = [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "chars", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chars long, digest binary")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, and its winner and number of rows; combined before the shuffle."""
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("by_id"))).alias("best")  # null, the least, for no doc_id
    found = rows.groupBy("digest").agg(best, F.count("*").alias("count"))
    return found.select("digest", "best.chars", F.bitwise_not("best.by_id").alias("doc_id"), "count")


def bits_for(keys: int) -> int:
    return min(MAX_BITS, max(0, (max(keys, 1) - 1) // KEYS_PER_BUCKET).bit_length())


def bucket_of(bits: int) -> Column:
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.shiftrightunsigned(first, 32 - bits)


def _stored(spark: SparkSession, rows: DataFrame, bits: int) -> Index:
    path = new_folder(spark, "digest-index")
    rows.write.parquet(path)
    return Index(spark.read.schema(_BUCKET).parquet(path), bits, path)


def _extended(key, index: pa.Table, arrivals: pa.Table) -> pa.Table:
    """A bucket after a batch: repeats go to their slots, the others get slots of their own."""
    new = Entries.of(words_of(arrivals.column("digest")), arrivals.column("doc_id"), arrivals.column("chars"), arrivals.column("count"))
    bucket = Bucket.read(index)
    if bucket is None:
        bucket = Bucket(new)
    elif arrivals.num_rows:
        slots, member = bucket.find(new.words)
        bucket.entries.take(slots[member], new[member])
        if not member.all():
            bucket = Bucket(bucket.entries + new[~member])
    return bucket.row(key[0].as_py())


def build(spark: SparkSession, arrivals: DataFrame, bits: int) -> Index:
    """An index of grouped() digests."""
    return extend(Index(spark.createDataFrame([], _BUCKET), bits, ""), arrivals)


def entries(index: Index) -> DataFrame:
    """What grouped() gave for all that the index holds."""
    slot = F.posexplode(F.arrays_zip("ids", "chars", "counts")).alias("slot", "of")
    digest = F.expr("substring(digests, slot * 32 + 1, 32)").alias("digest")
    return index.rows.select("digests", slot).select(digest, "of.chars", F.col("of.ids").alias("doc_id"), F.col("of.counts").alias("count"))


def extend(index: Index, arrivals: DataFrame) -> Index:
    """The index after a batch of grouped() digests; a new table, the old one stays."""
    spark, arrivals = arrivals.sparkSession, checkpointed(arrivals)
    held = index.rows.agg(F.sum(F.size("ids"))).first()[0] or 0
    bits = bits_for(held + arrivals.count())
    if held and bits > index.bits + 1:
        index = build(spark, entries(index), bits)
    keys = arrivals.withColumn("bucket", bucket_of(index.bits))
    rows = index.rows.groupBy("bucket").cogroup(keys.groupBy("bucket")).applyInArrow(_extended, _BUCKET)
    return _stored(spark, rows, index.bits)


def _looked_up(key, index: pa.Table, rows: pa.Table) -> pa.Table:
    n, bucket = rows.num_rows, Bucket.read(index)
    slots, member = bucket.find(words_of(rows.column("digest"))) if bucket and n else (np.zeros(n, np.int64), np.zeros(n, bool))
    columns = [rows.column(c) for c in ("doc_id", "chars", "digest")]
    if bucket is None:
        found = [pa.nulls(n, pa.int64())] * 3
    else:
        e, at = bucket.entries, np.where(member, slots, 0)
        found = [pa.array(e.ids[at], mask=~(member & e.has_id[at])), pa.array(e.chars[at], mask=~member), pa.array(e.counts[at], mask=~member)]
    return pa.table([*columns, *found, pa.array(member)], names=["doc_id", "chars", "digest", "keep_id", "keep_chars", "group_size", "is_member"])


def lookup(index: Index, rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds keep_id, keep_chars and group_size (null for strangers) and is_member to digested() rows, which should come from a table."""
    rows = rows.select("doc_id", "chars", "digest", bucket_of(index.bits).alias("bucket"))
    many = F.greatest(F.lit(rows_per_task), F.lit(rows.count() // HOT_SHARE))
    parts = rows.groupBy("bucket").count().filter(F.col("count") > many).select("bucket", F.ceil(F.col("count") / many).cast("int").alias("parts"))
    parts = F.broadcast(checkpointed(parts))
    part = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = rows.join(parts, "bucket", "left").withColumn("part", part).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    of = index.rows.join(parts, "bucket", "left").withColumn("part", copies).drop("parts")
    schema = "doc_id long, chars long, digest binary, keep_id long, keep_chars long, group_size long, is_member boolean"
    return of.groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part")).applyInArrow(_looked_up, schema)


def decisions(rows: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, Index]:
    """lookup() of digested() rows in an index of them and the history (digested() too), with kept, whether the row stays; and the index."""
    spark, total = rows.sparkSession, rows.count()
    if history is None:
        index = build(spark, grouped(rows), bits_for(total))
    else:
        first = build(spark, grouped(history), bits_for(total + history.count()))
        index = extend(first, grouped(rows))
        remove(spark, first.path)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return lookup(index, rows if history is None else history.unionByName(rows)).withColumn("kept", kept), index


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with the same columns; rows alike in doc_id and text count as one."""
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "digests")
    digested(docs).write.parquet(path)
    found = decisions(spark.read.parquet(path))[0].filter("kept").select("doc_id", "chars", "digest").distinct()
    without_space = F.translate(F.coalesce("text", F.lit("")), _SPACE.decode(), "")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.unhex(F.sha2(without_space, 256)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("rows.chars") == F.col("kept.chars")) & (F.col("rows.digest") == F.col("kept.digest"))
    return rows.alias("rows").join(found.alias("kept"), same, "left_semi").dropDuplicates(["id", "chars", "digest"]).select("row.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are the history, the other half arrives; all of them are looked up in the end."""
    path = new_folder(spark, "digests")
    digested(table(spark, sf_dir, "documents")).write.parquet(path)
    rows, earlier = spark.read.parquet(path), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found, _ = decisions(rows.filter(~earlier), rows.filter(earlier))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal FROM documents
), placed AS (
  SELECT doc_id, normal, row_number() OVER (PARTITION BY normal ORDER BY chars DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY normal ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size
  FROM texts
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM placed"""
