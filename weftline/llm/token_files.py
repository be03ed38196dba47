"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

An id is written as its rank by frequency in the corpus, in one to four little-endian bytes. The byte counts stand apart
from the data: two bits an id, four ids a control byte. Decoding looks up each control byte's lengths and offsets in
tables and gathers all ids of a block at once.

A folder holds ``ranks.bin`` (the ids in rank order, unsigned 32-bit) and ``part-NNNNN.wtb`` files in document order.
A file is a row of blocks: documents, ids, control bytes and data bytes as four unsigned 64-bit numbers, then document
ids (signed 64-bit; the least number stands for null), their id counts (unsigned 64-bit), control bytes and data.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, materialize, scratch_path, tidy
from weftline.llm.tokens import WORD_VOCABULARY, encoder

#: Ids of a block (a longer document is a block of its own); code points of text for each file.
BLOCK, FILE_CHARS = 1 << 19, 24_000_000
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4Q")

_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
#: For each control byte: the lengths of its ids, their offsets, and the sum of the lengths.
_LENGTHS = _CODES + 1
_OFFSETS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _head(*sizes: int) -> bytes:
    return _HEAD.pack(*sizes)


def _sizes(head: bytes) -> tuple[int, int, int, int]:
    return _HEAD.unpack(head)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes; the last control byte's unused codes are 0 and have no data."""
    ranks = np.ascontiguousarray(ranks, np.dtype("<u4"))
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    four = padded.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(control, np.uint8)
    total = _TOTALS[c]
    at = ((np.cumsum(total) - total)[:, None] + _OFFSETS[c]).reshape(-1)[:n]
    codes = _CODES[c].reshape(-1)[:n]
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for j in range(int(codes.max(initial=0)) + 1):
        out |= raw[at + j] << np.uint32(8 * j)
    return out & _MASKS[codes]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that Python can write to, and the path there, from a path or URI."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, chunks: Iterator[bytes]) -> None:
    """Write under a name of its own and rename, so that a task that runs twice leaves one whole file."""
    system, path = _place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(aside, path)


def _tokenized(vocabulary: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Kind 0: a document's ids, compressed; kind 1: an id and how often the task met it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, squeeze = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(1 << 16, np.int64)
        for pdf in batches:
            blocks, sizes = [], []
            coded = tok.documents(pdf["text"].tolist())
            met = np.bincount(np.concatenate(coded)) if coded else counts[:0]
            if len(met) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(met) - len(counts), np.int64)])
            counts[: len(met)] += met
            for ids in coded:
                blocks.append(squeeze.compress((ids.astype("<u2") if len(met) <= 1 << 16 else ids).tobytes()))
                sizes.append(len(ids))
            yield pd.DataFrame({"kind": np.int32(0), "id": pdf["id"].astype("Int64"), "h": pdf["h"], "n": np.array(sizes, np.int64), "block": blocks})
        met = np.flatnonzero(counts)
        yield pd.DataFrame({"kind": np.int32(1), "id": pd.array(met, "Int64"), "h": np.int64(0), "n": counts[met], "block": None})

    return tidy(run)


def _written(folder: str, rank_of) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ranks, expand = TaskContext.get().partitionId(), rank_of.value, zstandard.ZstdDecompressor()
        told = {"part": part, "docs": 0, "tokens": 0}

        def blocks() -> Iterator[bytes]:
            doc_ids, parts, held = [], [], 0

            def block() -> bytes:
                flat = np.concatenate(parts)
                control, data = encode_ranks(ranks[flat])
                told["docs"] += len(parts)
                told["tokens"] += len(flat)
                return b"".join([_head(len(parts), len(flat), len(control), len(data)), np.array(doc_ids, "<i8").tobytes(), np.array([len(x) for x in parts], "<u8").tobytes(), control, data])

            for pdf in batches:
                for doc_id, n, squeezed in zip(pdf["id"].astype("Int64"), pdf["n"], pdf["block"], strict=True):
                    raw = expand.decompress(squeezed)
                    doc_ids.append(NULL_ID if doc_id is pd.NA else int(doc_id))
                    parts.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                    held += n
                    if held >= BLOCK:
                        yield block()
                        doc_ids, parts, held = [], [], 0
            if parts:
                yield block()

        write_whole(f"{folder}/part-{part:05d}.wtb", blocks())
        yield pd.DataFrame([told]).astype({"part": "int32", "docs": "int64", "tokens": "int64"})

    return tidy(run)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = WORD_VOCABULARY, text_col: str = "text", id_col: str = "doc_id", file_chars: int = FILE_CHARS) -> list[tuple[int, int, int]]:
    """Encode docs into folder; returns (part, documents, ids) of its files, in order.

    Every row is a document and ends with the end id, null and empty texts included. Documents are in ascending order of
    id, nulls first; rows of one id go by a hash of their text. An empty table gives empty files. Other columns are not
    read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    coded = materialize(texts.mapInPandas(_tokenized(vocabulary), "kind int, id long, h long, n long, block binary"), "token-ids")
    counted = coded.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary at most
    counted = counted.sort_values(["n", "id"], ascending=[False, True])
    by_rank = counted["id"].to_numpy(np.int64)
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    write_whole(f"{folder}/ranks.bin", iter([by_rank.astype("<u4").tobytes()]))

    ids = coded.where("kind = 0").select("id", "h", "n", "block")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(ids.agg(F.sum("n")).first()[0] or 0) * 4 // file_chars))
    ranged = ids.repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h")
    told = ranged.mapInPandas(_written(folder, spark.sparkContext.broadcast(ranks)), "part int, docs long, tokens long")
    return sorted(tuple(r) for r in told.collect())  # a row a file


def _read(folder: str, rank_path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _place(rank_path)
        with system.open_input_stream(path) as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for pdf in batches:
            for part, start in zip(pdf["part"], pdf["start"], strict=True):
                system, path = _place(f"{folder}/part-{part:05d}.wtb")
                with system.open_input_stream(path) as f:
                    while head := f.read(32):
                        n_docs, n, n_control, n_data = _sizes(head)
                        doc_ids, counts = np.frombuffer(f.read(8 * n_docs), "<i8"), np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
                        flat = by_rank[decode_ranks(f.read(n_control), f.read(n_data), n)]
                        ends = np.cumsum(counts)
                        yield pd.DataFrame({"id": pd.array([None if i == NULL_ID else i for i in doc_ids.tolist()], "Int64"), "start": start + ends - counts, "n_tokens": counts, "ids": [x.tobytes() for x in np.split(flat.astype("<u4"), ends[:-1])]})
                        start += n

    return tidy(run)


def read_tokens(spark, folder: str, files: list[tuple[int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit) of the folder's documents."""
    rows, start = [], 0
    for part, _, tokens in files:
        rows.append((part, start))
        start += tokens
    listed = spark.createDataFrame(rows, "part int, start long").repartition(max(1, len(rows)), "part")
    return listed.mapInPandas(_read(folder, f"{folder}/ranks.bin"), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def checksums(coded: DataFrame) -> DataFrame:
    """read_tokens' rows with ids_crc32 in the place of the ids.

    The JVM computes it: a second Python step would have a worker of its own beside the first one's, in every task.
    """
    return coded.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def token_folder(spark) -> str:
    return scratch_path(spark, "token-folder")
