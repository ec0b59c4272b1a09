"""Token-id files: frequency-ranked ids in byte-aligned variable length with separate control bytes (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import partitions, saved, small
from tidemark.llm.vocabulary import in_pieces, word_encoder
from tidemark.llm.words import column_bytes

#: A segment, one row of a file, holds about so many ids; a longer document is a segment of its own.
SEGMENT = 1 << 18
SEGMENT_SCHEMA = "shard int, segment int, first long, doc_ids array<long>, lengths array<long>, n_tokens long, control binary, data binary"

#: By control byte: the byte lengths of the four ids that it describes (two bits each, lowest first, length - 1).
_LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes: each rank in its 1 to 4 significant bytes, lowest first."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: a table gives the lengths behind each control byte, their running sum where each rank begins."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    ranks = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        ranks[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's ids and the end id."""
        encoder, end = word_encoder(path), np.uint32(end_id).tobytes()
        for batch in batches:
            at = 0
            for texts in in_pieces(column_bytes(batch.column("text"))):
                coded = [c + end for c in encoder.ids([t.split() for t in texts])]
                kept = [batch.column(c).slice(at, len(coded)) for c in ("doc_id", "hash")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([_narrow(c) for c in coded], pa.binary())], names=["doc_id", "hash", "ids"])
                at += len(coded)

    return encode


def _narrow(ids: bytes) -> bytes:
    """Ids for the way between tasks: a byte for their width, then 16 bits each where they all fit."""
    values = np.frombuffer(ids, dtype="<u4")
    return b"\2" + values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else b"\4" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype=f"<u{ids[0]}", offset=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each id in this task's documents."""
    totals = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for ids in batch.column("ids").to_pylist():
            found = np.bincount(_wide(ids), minlength=len(totals))
            found[: len(totals)] += totals
            totals = found
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(totals[used])], names=["id", "n"])


def _writer(rank_of: np.ndarray):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of this task's documents, in the order they come."""
        first = segment = size = 0
        doc_ids, coded, shard = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, segment, size, doc_ids, coded
            lengths = [len(c) for c in coded]
            control, data = pack(np.concatenate(coded))
            row = {"shard": shard, "segment": segment, "first": first, "doc_ids": doc_ids, "lengths": lengths, "n_tokens": size, "control": control, "data": data}
            first, segment, size, doc_ids, coded = first + size, segment + 1, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT_ARROW)

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if len(batch) else shard
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                coded.append(rank_of[_wide(ids)])
                size += len(coded[-1])
                if size >= SEGMENT:
                    yield flush()
        if coded:
            yield flush()

    return write


_SEGMENT_ARROW = pa.schema(
    [("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary())]
)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by end_id, under `path`: files in ascending order of id.

    `path`/ranks holds rank and id of every id that occurs, the most frequent first (ties: the smaller id), counted
    over all documents; at most the vocabulary's size. `path`/segments holds one file for each range of ids; a
    row is a segment of whole documents: its ranks' control bytes and data bytes, ids and lengths of its documents,
    and `first`, the ids before it in its file (shard).

    Null text: empty, so only end_id. Null ids come first. Rows of equal id follow a hash of their texts; rows equal
    in both are interchangeable. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    tokens = saved(texts.mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, hash long, ids binary"), "token-ids", compression="zstd")
    counts = tokens.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ids = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]  # a row for each id of the vocabulary at most
    spark.createDataFrame(list(enumerate(ids)), "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    ranged = tokens.repartitionByRange(partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ranged = ranged.select("doc_id", "ids", F.spark_partition_id().alias("shard"))
    ranged.mapInArrow(_writer(rank_of), SEGMENT_SCHEMA).write.parquet(f"{path}/segments", compression="zstd")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    table = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(len(table), dtype="<u4")
    for r in table:
        id_of[r["rank"]] = r["id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_tokens"])]
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                coded = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(coded), row["shard"], dtype=np.int32)), pa.array(starts + row["first"]), pa.array(row["lengths"], pa.int64()), pa.array(coded, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "shard", "at", "n_tokens", "ids"])

    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = small(totals.select(F.col("shard").alias("__shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")), "shard-starts")
    docs = segments.mapInArrow(decode, "doc_id long, shard int, at long, n_tokens long, ids binary")
    return docs.join(before, F.col("shard") == F.col("__shard")).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


