"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of one ``*.tokens`` file, all numbers little-endian:

* one zstandard frame per document (several for a document beyond ``FRAME_IDS`` ids), holding its ids
  as unsigned 32-bit integers;
* a skippable frame (magic 0x184D2A50) with the documents: id (8 bytes signed), 1 if the id is not
  null (1 byte), number of frames (4 bytes);
* a skippable frame (magic 0x184D2A5E) with the seek table of the public zstd seekable format: per
  frame its compressed size, its size, and the low 32 bits of the XXH64 of its content; then the number
  of frames, a descriptor byte with the checksum flag, and the magic 0x8F92EAB1.

A zstd tool that knows nothing of this reads the whole file as one stream; a reader takes the table from
the file's end and decompresses only the frames it wants, checking each.

Documents are dealt to files by ranges of their id, so the files in order hold all documents in order.
A task writes a file of a new name and reports it in a row; the manifest table holds the rows of the
tasks that succeeded, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
from itertools import groupby

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintflow.llm.common import id_text, slices, text_of
from stintflow.session import scratch_path

FRAME_IDS = 1 << 22
# fixed values of the public zstd seekable format
SKIPPABLE_DOCS, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
HEAD, ENTRY, FOOT = struct.Struct("<II"), np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")]), struct.Struct("<IBI")
DOC = np.dtype([("id", "<i8"), ("valid", "u1"), ("frames", "<u4")])

# The White_Space characters of Unicode, letters of the Latin blocks, and ASCII punctuation.
BLANK = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
LATIN = "A-Za-z\\xC0-\\xD6\\xD8-\\xF6\\xF8-\\u024F"
POINT = "!-/:-@\\[-`{-~"
PIECE = (
    f"[ ]?[{LATIN}]+(?=[{POINT}{BLANK}]|$)|[ ]?[^{BLANK}]+"
    f"|[{BLANK}]+(?= [^{BLANK}])|[{BLANK}](?=[^{BLANK}])|[{BLANK}]+[^{BLANK}]+|[{BLANK}]+"
)
CACHE = 800_000


class PieceEncoder:
    """Encodes with a byte-level BPE of the tokenizers library, remembering the ids of pieces.

    Such a tokenizer first cuts a text into pretokens and encodes each by itself. It always cuts between
    a non-blank character and white space, where a single space goes with the word after it, and between
    letters and punctuation. ``PIECE`` cuts only at such places, so the ids of the pieces, one after the
    other, are the ids of the whole text.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pretokens, self.tokens = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile(PIECE).findall
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> list[int]:
        """Through the pre-tokenizer and the model alone, which skips most of the cost of a whole encoding."""
        if any(special in piece for special in self.special):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [t.id for part, _ in self.pretokens(piece) for t in self.tokens(part)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for piece in {p for pieces in cut for p in pieces if p not in known}:
            known[piece] = np.array(self._ids(piece), "<u4").tobytes()
        return [b"".join([known[p] for p in pieces]) for pieces in cut]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


class TokenFile:
    """Writes one file; ``add`` takes a document's id (or None) and its ids as bytes."""

    def __init__(self, uri: str, level: int):
        import zstandard

        self.filesystem, path = pafs.FileSystem.from_uri(uri)
        self.out = self.filesystem.open_output_stream(path)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.docs: list[tuple] = []
        self.frames: list[tuple] = []
        self.ids = 0

    def add(self, doc_id, ids: bytes) -> None:
        import xxhash

        step = FRAME_IDS * 4
        parts = [ids[at : at + step] for at in range(0, len(ids), step)] or [b""]
        for part in parts:
            packed = self.pack(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(parts)))
        self.ids += len(ids) // 4

    def close(self) -> int:
        """Write the tables; returns the bytes from the document table to the end."""
        docs = np.array(self.docs, DOC).tobytes()
        seek = np.array(self.frames, ENTRY).tobytes() + FOOT.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        tail = HEAD.pack(SKIPPABLE_DOCS, len(docs)) + docs + HEAD.pack(SKIPPABLE_SEEK, len(seek)) + seek
        self.out.write(tail)
        self.out.close()
        return len(tail)


def _write(folder: str, tokenizer: str, end_id: int, level: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        encode = encoder(tokenizer).encode
        name = f"part-{uuid.uuid4().hex}.tokens"
        file = None
        for batch in slices(batches, 256):
            if file is None:
                file = TokenFile(f"{folder}/{name}", level)
            for doc_id, missing, ids in zip(batch["doc_id"], batch["doc_id"].isna(), encode(list(batch["text"]))):
                file.add(None if missing else int(doc_id), ids + end)
        if file is not None:
            tail = file.close()
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"part": [part], "file": [name], "n_docs": [len(file.docs)], "n_tokens": [file.ids], "tail": [tail]})

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    level: int = 3,
    files: int | None = None,
    order: tuple[str, ...] = (),
) -> str:
    """Encode and write all documents in ascending order of a whole-number id; returns the folder.

    With ``order`` the documents follow these columns first, nulls last, and the id only where they are equal.

    ``tokenizer`` is the path of a vocabulary file that the executors have. Null and empty texts hold the
    end id alone; null ids come last; rows that share an id are written each, ordered by text hash. An
    empty table gives a folder without files. Other columns are not read. ``files`` defaults to the number
    of shuffle partitions. The folder must be one that all executors and the driver share.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    filesystem, path = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(path)
    by = [f"_by_{i}" for i in range(len(order))]
    sorting = [*[F.col(b).asc_nulls_last() for b in by], F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), *[F.col(c).alias(b) for c, b in zip(order, by)])
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *sorting)
        .sortWithinPartitions(*sorting)
    )
    schema = "part bigint, file string, n_docs bigint, n_tokens bigint, tail bigint"
    manifest = dealt.select(id_text("doc_id").alias("doc_id"), "text").mapInPandas(_write(folder, tokenizer, end_id, level), schema)
    manifest.write.parquet(f"{folder}/manifest")
    return folder


def read_tail(uri: str, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """The document table and the seek table of a file, from its last ``tail`` bytes."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(path) as source:
        source.seek(source.size() - tail)
        raw = source.read(tail)
    magic, size = HEAD.unpack_from(raw)
    docs = np.frombuffer(raw, DOC, size // DOC.itemsize, HEAD.size)
    count, flag, end = FOOT.unpack_from(raw, len(raw) - FOOT.size)
    if (magic, flag, end) != (SKIPPABLE_DOCS, CHECKSUM_FLAG, SEEKABLE_MAGIC):
        raise ValueError(f"{uri} has no seek table")
    return docs, np.frombuffer(raw, ENTRY, count, len(raw) - FOOT.size - count * ENTRY.itemsize)


INDEX = "doc_id bigint, start bigint, n_tokens bigint, file string, offset bigint, frames array<struct<packed:bigint,size:bigint,check:bigint>>"


def _index(folder: str):
    def run(batches):
        for row in (r for batch in batches for r in batch.itertuples(index=False)):
            docs, frames = read_tail(f"{folder}/{row.file}", row.tail)
            ends = np.cumsum(frames["packed"], dtype=np.int64)
            last = np.cumsum(docs["frames"], dtype=np.int64)
            start = int(row.base)
            for lot in range(0, len(docs), 4096):
                out = []
                for doc, upto in zip(docs[lot : lot + 4096], last[lot : lot + 4096]):
                    mine = frames[upto - doc["frames"] : upto]
                    tokens = int(mine["size"].sum(dtype=np.int64)) // 4
                    offset = int(ends[upto - 1] - mine["packed"].sum(dtype=np.int64))
                    parts = [{"packed": int(f["packed"]), "size": int(f["size"]), "check": int(f["check"])} for f in mine]
                    out.append((int(doc["id"]) if doc["valid"] else None, start, tokens, row.file, offset, parts))
                    start += tokens
                names = ["doc_id", "start", "n_tokens", "file", "offset", "frames"]
                yield pd.DataFrame(dict(zip(names, zip(*out))) | {"doc_id": pd.array([o[0] for o in out], dtype="Int64")}, columns=names)

    return run


def _based(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, a row per file, with the ids of all files before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def document_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document lies: ``doc_id, start, n_tokens, file, offset, frames``, from the files' ends alone.

    ``start`` counts the ids of all documents before; the running total needs one row per file.
    """
    return _dealt(_based(spark, folder)).mapInPandas(_index(folder), INDEX)


def _dealt(files: DataFrame) -> DataFrame:
    """Files to tasks by a number of partitions that the manifest's few bytes cannot shrink."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "tail", "base").repartition(parts, "file")


def _file_digests(folder: str):
    import zlib

    import xxhash
    import zstandard

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for row in (r for batch in batches for r in batch.itertuples(index=False)):
            uri = f"{folder}/{row.file}"
            docs, frames = read_tail(uri, row.tail)
            checks, sizes, packed = frames["check"].tolist(), frames["size"].tolist(), frames["packed"].tolist()
            filesystem, path = pafs.FileSystem.from_uri(uri)
            crcs, counts, at = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), 0
            with filesystem.open_input_stream(path, buffer_size=1 << 20) as source:
                for k, parts in enumerate(docs["frames"].tolist()):
                    crc = ids = 0
                    for at in range(at, at + parts):
                        part = unpack(source.read(packed[at]), max_output_size=max(1, sizes[at]))
                        if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != checks[at]:
                            raise ValueError(f"checksum of a frame in {row.file} differs")
                        crc = zlib.crc32(part, crc)
                        ids += len(part) // 4
                    at += 1
                    crcs[k], counts[k] = crc, ids
            start = row.base + np.cumsum(counts) - counts
            ids = pd.array(docs["id"], dtype="Int64")
            ids[docs["valid"] == 0] = pd.NA
            yield pd.DataFrame({"doc_id": ids, "start": start, "n_tokens": counts, "ids_crc32": crcs})

    return run


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`token_digests` of all documents, each file read through once, frame by frame, every checksum tested."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return _dealt(_based(spark, folder)).mapInPandas(_file_digests(folder), schema)


def _fetch(folder: str):
    import xxhash
    import zstandard

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, 512):
            ids = []
            for file, rows in groupby(batch.itertuples(index=False), key=lambda r: r.file):
                filesystem, path = pafs.FileSystem.from_uri(f"{folder}/{file}")
                with filesystem.open_input_file(path) as source:
                    for row in rows:
                        source.seek(row.offset)
                        whole = []
                        for frame in row.frames:
                            part = unpack(source.read(frame["packed"]), max_output_size=max(1, frame["size"]))
                            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != frame["check"]:
                                raise ValueError(f"checksum of a frame in {file} differs")
                            whole.append(part)
                        ids.append(b"".join(whole))
            out = batch[["doc_id", "start", "n_tokens"]].copy()
            out["ids"] = ids
            yield out

    return run


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the given rows of the index; other frames are not decompressed.

    ``ids`` are little-endian unsigned 32-bit integers. A frame that fails its checksum is an error.
    """
    rows = index.select(id_text("doc_id").alias("doc_id"), "start", "n_tokens", "file", "offset", "frames")
    found = rows.mapInPandas(_fetch(folder), "doc_id string, start bigint, n_tokens bigint, ids binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def token_digests(fetched: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of fetched documents."""
    return fetched.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
