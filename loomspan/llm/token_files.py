"""Token-id files: independent zstandard frames, a seek table at the end, checksums.

A shard is a run of zstandard frames, each the ids of some whole documents as
little-endian unsigned 32-bit integers. Two skippable frames end the file, so that
plain zstandard tools still read it: the index of documents (id, frame, offset in the
frame and length, in ids), then the seek table of the public seekable format, whose
entries hold a frame's compressed and decompressed size and the low 32 bits of the
XXH64 of its content. A reader takes the two tables from the file's end and
decompresses only the frames it wants, checking each.

Shards hold ascending ranges of ids. Tasks write to names of their own; the manifest, a
table that Spark commits, names the file of the attempt that counts, so that repeated or
lost tasks leave no trace in what is read.

Defined cases: null text is empty (the end id alone); a null id sorts first and stays
null; rows with equal ids follow each other in order of text; very long texts are encoded
whole, in a frame that is as long as it takes; an empty table makes no
shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import shared_dir, table
from loomspan.llm.tokens import default_tokenizer, encoder

# Fixed values of the public zstandard and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

END_ID = 2
#: A frame is closed once it holds so many bytes of ids.
FRAME_BYTES = 1 << 18
NULL_ID = -(1 << 63)
INDEX = np.dtype([("id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


def _checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class ShardWriter:
    """Writes documents' ids to an open binary file."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level)
        self._out, self._held, self._size = out, [], 0
        self._index: list[tuple] = []
        self._seek: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        self._index.append((doc_id, len(self._seek), self._size // 4, len(ids) // 4))
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        plain = b"".join(self._held)
        packed = self._zstd.compress(plain)
        self._out.write(packed)
        self._seek.append((len(packed), len(plain), _checksum(plain)))
        self._held, self._size = [], 0

    def finish(self) -> None:
        if self._held:
            self._close_frame()
        index = np.array(self._index, INDEX).tobytes()
        seek = np.array(self._seek, ENTRY).tobytes() + struct.pack("<IBI", len(self._seek), HAS_CHECKSUMS, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class ShardReader:
    """Reads documents' ids from an open random-access file of ``size`` bytes."""

    def __init__(self, file, size: int):
        import zstandard

        self._file, self._zstd = file, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - n * ENTRY.itemsize
        self.seek = np.frombuffer(self._at(table_at, n * ENTRY.itemsize), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        index_at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(index_at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no index of documents before the seek table")
        self.index = np.frombuffer(self._at(index_at + 8, length), INDEX)

    def _at(self, offset: int, n: int) -> bytes:
        self._file.seek(int(offset))
        return self._file.read(int(n))

    def frame(self, k: int) -> bytes:
        e = self.seek[k]
        plain = self._zstd.decompress(self._at(self.starts[k], e["packed"]), max_output_size=int(e["plain"]))
        if len(plain) != e["plain"] or _checksum(plain) != e["check"]:
            raise ValueError(f"frame {k} fails its checksum")
        return plain

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(id, ids before it in the shard, its ids), decompressing only frames in need."""
        before = np.cumsum(self.index["length"], dtype=np.int64) - self.index["length"]
        rows = np.arange(len(self.index)) if wanted is None else np.flatnonzero(np.isin(self.index["id"], list(wanted)))
        held, plain = -1, b""
        for i in rows:
            doc, k, offset, length = self.index[i].tolist()
            if k != held:
                held, plain = k, self.frame(k)
            yield doc, int(before[i]), plain[4 * offset : 4 * (offset + length)]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every row and writes shards in ascending id order; returns the manifest."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        name, writer, docs_in, ids_in = f"{base}/shard-{uuid.uuid4().hex}.zst", None, 0, 0
        for batch in batches:
            if writer is None and len(batch):
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(name, compression=None)
                writer = ShardWriter(out)
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                for doc, ids in zip(part["doc_id"], encode(part["text"].tolist())):
                    writer.add(NULL_ID if pd.isna(doc) else int(doc), ids + end)
                    docs_in, ids_in = docs_in + 1, ids_in + len(ids) // 4 + 1
        if writer:
            writer.finish()
            out.close()
            shard = TaskContext.get().partitionId()
            yield pd.DataFrame({"shard": [shard], "path": [name], "n_docs": [docs_in], "n_tokens": [ids_in]})

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = table(ordered.mapInPandas(write, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    total = F.sum("n_tokens").over(Window.orderBy("shard"))
    return manifest.withColumn("first_token", total - F.col("n_tokens")).withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids as bytes) of all or only the wanted documents."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                store, _ = fs.FileSystem.from_uri(r.folder)
                with store.open_input_file(r.path) as f:
                    rows, held = [], 0
                    for doc, before, ids in ShardReader(f, f.size()).documents(wanted):
                        rows.append((None if doc == NULL_ID else doc, r.first_token + before, ids))
                        held += len(ids)
                        if held > 1 << 24:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})

    # one shard a row and a task: the manifest is small, its shards are not
    spread = manifest.repartitionByRange(manifest.sparkSession.sparkContext.defaultParallelism * 4, "shard")
    return spread.mapInPandas(read, "doc_id long, start long, ids binary")


def op9_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids to token files and reports what is read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, default_tokenizer(), shared_dir(spark, "token-files"))
    return read_token_files(manifest).selectExpr(
        "doc_id", "start", "cast(length(ids) div 4 as long) n_tokens", "crc32(ids) ids_crc32"
    )
