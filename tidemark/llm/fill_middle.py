"""Fill-in-middle transformation through an index of distinct texts (operator 13)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import saved, small
from tidemark.llm.words import column_bytes

#: Sentinels before prefix, suffix and middle; texts that hold one stay plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents with a text so many are transformed, and of 100 of these so many put the suffix first.
FIM_RATE, SPM_RATE = 50, 80
#: Boundary lists of at most this many bytes together are broadcast; beyond it only those of hot texts are.
BROADCAST_BYTES = 64 << 20
#: A text is hot if it has more than this part of all rows; so fewer than 1 / HOT texts are.
HOT = 0.001

_HEAD = struct.Struct("<QQB")


def boundaries(text: bytes) -> np.ndarray:
    """The byte offsets at which the tokens of a text end: a word with the white space before it, and white space at the end."""
    raw = np.frombuffer(text, dtype=np.uint8)
    space = np.ones(len(raw) + 1, dtype=bool)
    space[:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw)) if len(raw) and space[-2] else ends


def pack(ends: np.ndarray, universe: int) -> bytes:
    """Rising offsets up to `universe` as an Elias-Fano list: low bits side by side, high parts as ones in a bit vector."""
    n = len(ends)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    low = ((ends[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros(n + (universe >> width) + 1, dtype=np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return _HEAD.pack(n, universe, width) + np.packbits(low.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def length(packed: bytes) -> int:
    return _HEAD.unpack_from(packed)[0]


def select(packed: bytes, i: int) -> int:
    """The i-th offset of an Elias-Fano list, from 1; 0 for i = 0."""
    if i == 0:
        return 0
    n, _, width = _HEAD.unpack_from(packed)
    first = i * width - width
    low = int.from_bytes(packed[_HEAD.size + first // 8 : _HEAD.size + (first + width + 7) // 8], "little") >> first % 8 & ((1 << width) - 1)
    bits = np.frombuffer(packed, dtype=np.uint8, offset=_HEAD.size + (n * width + 7) // 8)
    ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    byte = int(np.searchsorted(ones, i))
    inside = i - int(ones[byte - 1]) if byte else i
    place = 8 * byte + int(np.flatnonzero(np.unpackbits(bits[byte : byte + 1], bitorder="little"))[inside - 1])
    return (place - (i - 1)) << width | low


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit integers of a document; a null id counts as an empty one."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return list(struct.unpack(">4I", digest[:16]))


def _characters(text: bytes) -> int:
    return int(((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80).sum())


def cut(text: bytes, packed: bytes, draws: list[int]) -> tuple[str, int | None, int | None, bytes]:
    """form, characters of prefix and of middle (None if plain), output."""
    n = length(packed)
    h1, h2, h3, h4 = draws
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= FIM_RATE:
        return "plain", None, None, text
    a, b = (select(packed, i) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_RATE:
        return "spm", _characters(prefix), _characters(middle), SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", _characters(prefix), _characters(middle), PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(boundaries(text), len(text)) for text in column_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(packed, pa.binary())], names=["digest", "ends"])


def _cutter(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, begun = batch.column("doc_id").to_pylist(), 0, 0
            rows: list[tuple] = []
            for doc_id, text, ends in zip(ids, column_bytes(batch.column("text")), batch.column("ends"), strict=True):
                packed = ends.as_py() or pack(boundaries(text), len(text))  # a text of one row has its list made here
                rows.append((length(packed), *cut(text, packed, _draws(seed, doc_id))))
                at, begun = at + 1, begun + len(text)
                if begun > 8 << 20:
                    yield _out(batch.column("doc_id")[at - len(rows) : at], rows)
                    rows, begun = [], 0
            yield _out(batch.column("doc_id")[at - len(rows) : at], rows)

    return run


def _out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
    columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def index(docs: DataFrame) -> DataFrame:
    """digest, ends, copies: the Elias-Fano list of each text that more rows than one of docs (doc_id, text, digest) have, saved.

    Texts are identical if their SHA-256 is. Only digests are shuffled; of each group the row with the least id has its list made.
    """
    groups = docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("__least")).where("copies > 1")
    groups = small(groups.select(F.col("digest").alias("__digest"), "__least", "copies"), "fim-groups")
    chosen = docs.join(groups, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__least"))).select("digest", "text", "copies")
    made = saved(chosen.select("digest", "text").mapInArrow(_lists, "digest binary, ends binary"), "fim-lists")
    return saved(made.dropDuplicates(["digest"]).join(groups, F.col("digest") == F.col("__digest")).select(F.col("digest").alias("__digest"), "ends", "copies"), "fim-index")


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs with `ends`, null where the text has one row only."""
    weight = lists.agg(F.coalesce(F.sum(F.length("ends") + 64), F.lit(0)).alias("b")).first()["b"]
    same = F.col("digest") == F.col("__digest")
    if weight <= BROADCAST_BYTES:
        return docs.join(F.broadcast(lists.drop("copies")), same, "left")
    hot = lists.where(F.col("copies") > HOT * docs.count()).drop("copies")  # fewer than 1 / HOT rows
    if hot.agg(F.coalesce(F.sum(F.length("ends")), F.lit(0)).alias("b")).first()["b"] > BROADCAST_BYTES:
        hot = hot.withColumn("ends", F.lit(None).cast("binary"))  # texts too long to send their lists about: made where they are cut
    found = docs.join(F.broadcast(hot.toDF("__hot", "__ends")), F.col("digest") == F.col("__hot"), "left")
    # Hot rows need nothing more and are dealt out by their ids.
    key = F.when(F.col("__hot").isNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("~"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8"))
    found = found.withColumn("__key", key).join(lists.drop("copies").hint("merge"), F.col("__key") == F.col("__digest"), "left")
    return found.withColumn("ends", F.coalesce("__ends", "ends"))


def transform(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A token is a word with the white space (space, \\t-\\r) before it, or the white space at the end. The seed and the id
    decide the form and the two token boundaries that bound the middle. Plain: empty texts, those that hold a sentinel
    and those the draw leaves as they are.

    Null text: as an empty one. A null id draws like an empty id. Rows equal in id and text get equal results; copies
    under other ids share one boundary list and get cuts of their own. Empty table: no rows. Other columns are ignored.
    A very long text is cut by its list like any other; a task holds it as a whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    joined = _with_lists(rows, index(rows)).select("doc_id", "text", "ends")
    out = joined.mapInArrow(_cutter(seed), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("doc_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: no text that is cut holds a sentinel, and a sentinel can't begin inside another."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(transformed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of transform() with SHA-256 of the outputs and of the texts rebuilt from them."""
    sums = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return transformed.select(id_col, "n", "form", "prefix_chars", "middle_chars", *sums)
