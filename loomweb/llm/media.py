"""Operator 4, media columns: content-addressed payloads in tar shards.

Each text's bytes, filled up with bytes 255, are one greyscale picture (PNG, 8 bits, 576 samples a
row).  A task appends the pictures of its rows to a tar shard of its own in the shared folder,
each distinct payload once, named by its digest; rows carry digest, shard, offset and length.
A retried task writes another shard, and only the shard named by the rows that count is read.
The index keeps one place for each digest, and pictures are read once for all rows that share one.
Rows meet their picture's columns in a join on the digest, whose side of rows adaptive execution splits
where one digest's are too many for a task.
Metadata columns come from range reads of the pictures' headers alone; features from range reads
of whole pictures, spread over tasks by shard and window of offsets.

Defined results: null text: like an empty one (one row of samples); repeated texts: the same
payload, digest and feature; texts of any length: more rows of samples; no rows: no shards; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.shared import new_folder, qualified, table

WIDTH = 576
HEADER_BYTES = 33
MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
METADATA = "width int, height int, bits int, colour int"
WINDOW = 32 << 20


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload and the bytes of the text in it."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """width, height, bits and colour type from a picture's first 33 bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a picture")
    return struct.unpack(">IIBB", head[16:26])


def from_png(png: bytes) -> bytes:
    """The samples of a picture that to_png() made."""
    width, height, _, _ = read_header(png)
    at, data = 8, []
    while at < len(png):
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(png[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes shards and the manifest below folder and returns the manifest."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        shard, out, places, at = f"shard-{uuid.uuid4().hex}.tar", None, {}, 0
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    payload, n_bytes = padded(text)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in places:
                        if out is None:
                            files.create_dir(root, recursive=True)
                            out = files.open_output_stream(f"{root}/{shard}")
                        png = to_png(payload)
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(png)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        fill = b"\0" * (-len(png) % 512)
                        out.write(head + png + fill)
                        places[digest] = (at + len(head), len(png))
                        at += len(head) + len(png) + len(fill)
                    rows.append((doc_id, n_bytes, digest.hex(), shard, *places[digest]))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "digest", "shard", "offset", "length"]).astype({"doc_id": "Int64"})
            if out is not None:
                out.write(b"\0" * 1024)
        finally:
            if out is not None:
                out.close()

    spark = docs.sparkSession
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest dealt out by shard and window of offsets, so that a shard's reads go on in order and no shard is one task."""
    return manifest.repartition("shard", F.floor(F.col("offset") / WINDOW)).sortWithinPartitions("shard", "offset")


def read_back(manifest: DataFrame, folder: str, read, schema: str, header_only: bool = False) -> DataFrame:
    """Adds the columns of schema: read(bytes) for each picture, or for its header.  manifest is best spread()."""
    keep = [f"{name} {kind}" for name, kind in manifest.dtypes]
    names = [c.split()[0] for c in schema.split(", ")]

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            found: dict[tuple[str, int], tuple] = {}
            for shard, part in batch[["shard", "offset", "length"]].drop_duplicates().sort_values(["shard", "offset"]).groupby("shard"):
                with files.open_input_file(f"{root}/{shard}") as source:
                    for offset, length in zip(part["offset"], part["length"], strict=True):
                        found[shard, offset] = read(source.read_at(HEADER_BYTES if header_only else length, offset))
            values = [found[k] for k in zip(batch["shard"], batch["offset"], strict=True)]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(values, columns=names)], axis=1)

    return manifest.mapInPandas(ranges, ", ".join(keep) + ", " + schema)


def metadata(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with width, height, bits and colour, from header-only range reads."""
    return read_back(manifest, folder, read_header, METADATA, header_only=True)


def feature(samples: np.ndarray, height: int) -> str:
    """Size, mean and deviation of the samples, and a 64-bit average hash over 8 x 8 cells of the sample sequence."""
    cells = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64)
    sizes = np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    bits = cells * len(samples) > int(samples.sum(dtype=np.int64)) * sizes
    return f"{WIDTH}x{height}:{samples.mean(dtype=np.float64):.4f}:{samples.std(dtype=np.float64):.4f}:{np.packbits(bits).tobytes().hex()}"


def payload_columns(png: bytes) -> tuple:
    payload = from_png(png)
    samples = np.frombuffer(payload, np.uint8)
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-32:]),
        len(png),
        hashlib.sha256(png).hexdigest(),
        feature(samples, read_header(png)[1]),
    )


PAYLOAD = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def index_of(manifest: DataFrame) -> DataFrame:
    """One place for each digest; shards of several tasks may each hold a copy."""
    first = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))
    return first.select("digest", "place.shard", "place.offset", "place.length")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, new_folder(spark, "media"))
    manifest = store(table(spark, sf_dir, "documents"), folder)
    read = read_back(metadata(spread(index_of(manifest)), folder), folder, payload_columns, PAYLOAD)
    rows = manifest.select("doc_id", "n_bytes", "digest").join(read, "digest")
    return rows.select("doc_id", "n_bytes", *(c.split()[0] for c in PAYLOAD.split(", ")), "width", "height", "digest", "shard", "offset", "length")
