"""Token ids in seekable zstandard files (operator 4).

A token file holds the ids of consecutive documents (little-endian unsigned 32-bit) as
independent zstandard frames of about ``FRAME_IDS`` ids that end at document ends, then a
skippable frame with the document index, then the seek table: a skippable frame with, for each
data frame, its compressed size, its size and the low 32 bits of the XXH64 of its content, closed
by the number of frames, a flag byte and a magic number. A reader takes the table from the
file's end and decompresses only the frames of the documents it is asked for.

Documents are dealt by ascending doc_id to range partitions; each task writes one file under a
name of its own attempt and then renames it, so a retried task leaves one whole file. Files are
written and read by the file system that their address names (local, HDFS or object store).

Defined results: null text is empty (only the end id); null doc_id comes first; equal doc_ids
are ordered by text; an empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import documents, materialize, spread, whole_text
from .tokenize import SpaceLed, encoder, vocabulary

FRAME_IDS = 1 << 17
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n", "<u8"), ("frame", "<u4"), ("at", "<u8")])


def filesystem(uri: str):
    """(pyarrow file system, path) of an address or a plain path."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def checksum(data: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenWriter:
    """Writes one token file to an open stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.parts, self.held, self.table, self.index = [], 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > 4 * self.frame_ids:
            self.flush()
        self.index.append((doc_id or 0, doc_id is not None, len(ids) // 4, len(self.table), self.held // 4))
        self.parts.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        data = b"".join(self.parts)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), checksum(data)))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        index = self.packer.compress(np.array(self.index, dtype=_DOC).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(rows) + len(foot)) + rows + foot)


class TokenReader:
    """Reads documents of one token file; ``source`` is a seekable file."""

    def __init__(self, source):
        import zstandard
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table_at = end - 9 - 12 * n
        self.table = np.frombuffer(self._at(table_at, 12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        magic, size = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        self.index = np.frombuffer(self.unpacker.decompress(self._at(at + 8, size), max_output_size=1 << 40)
                                   if size else b"", dtype=_DOC)

    def _at(self, pos: int, n: int) -> bytes:
        self.source.seek(pos)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        size, whole, check = map(int, self.table[k])
        data = self.unpacker.decompress(self._at(int(self.starts[k]), size), max_output_size=whole)
        if len(data) != whole or checksum(data) != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, dtype="<u4")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) of the wanted rows of the index; all by default."""
        before = np.concatenate([[0], np.cumsum(self.index["n"], dtype=np.int64)])
        have, data = -1, None
        for i in range(len(self.index)) if rows is None else sorted(rows):
            doc_id, has_id, n, k, at = self.index[i].tolist()
            if k != have:
                have, data = k, self.frame(k)
            yield doc_id if has_id else None, int(before[i]), data[at:at + n]

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["has_id"] == 1)).tolist()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write token files below ``folder``; one manifest row per file (part, path, n_docs, n_tokens)."""
    end = struct.pack("<I", end_id)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encode, part = encoder(SpaceLed, tokenizer), TaskContext.get().partitionId()
        system, base = filesystem(folder)
        n_docs = n_ids = 0
        out = None
        path, own = f"part-{part:06d}.tok", f".part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{own}")
                    writer = TokenWriter(out, frame_ids)
                ids = encode(text) + end
                writer.add(doc_id, ids)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4
        if out is not None:
            writer.close()
            out.close()
            system.move(f"{base}/{own}", f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")) \
        .withColumns(spread())
    rows = rows.repartitionByRange("doc_id", *spread()).sortWithinPartitions("doc_id", *spread()).select("doc_id", "text")
    return rows.mapInArrow(write, "part long, path string, n_docs long, n_tokens long")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids of all documents before), ids."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(folder)
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                with system.open_input_file(f"{base}/{path}") as f:
                    held, size = [], 0
                    for doc_id, start, ids in TokenReader(f).documents():
                        held.append((doc_id, before + start, ids.astype(np.int64)))
                        size += len(ids)
                        if size > 1 << 20:
                            yield frame(held)
                            held, size = [], 0
                    if held:
                        yield frame(held)

    def frame(held: list) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pd.array([x[0] for x in held], dtype="Int64"), "start": [x[1] for x in held],
                             "ids": [x[2] for x in held]})

    return _files(manifest).mapInPandas(read, "doc_id long, start long, ids array<long>")


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """As ``read_tokens``, with the number of ids and their crc32 in place of the ids."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = filesystem(folder)
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                with system.open_input_file(f"{base}/{path}") as f:
                    rows = [(d, before + s, len(ids), zlib.crc32(ids.tobytes())) for d, s, ids in TokenReader(f).documents()]
                yield pd.DataFrame({"doc_id": pd.array([x[0] for x in rows], dtype="Int64"), "start": [x[1] for x in rows],
                                    "n_tokens": [x[2] for x in rows], "ids_crc32": [x[3] for x in rows]})

    return _files(manifest).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _files(manifest: DataFrame) -> DataFrame:
    """One task per file, with the ids of all files before it (the manifest has one row per file)."""
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    return files.repartition(max(1, manifest.count())).select("path", "before")


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens", uuid.uuid4().hex)
    manifest = materialize(write_tokens(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), end_id=0),
                           "token-manifest")
    return read_digests(manifest, folder)


QUERIES = {"op4_token_frames": op4_token_frames}
ORACLES: dict[str, str] = {}
