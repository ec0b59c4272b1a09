"""Token counts, huge documents by overlap resynchronisation (operator 6)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import partitions, saved
from tidemark.llm.vocabulary import in_pieces, tokenizer, word_encoder
from tidemark.llm.words import column_bytes

#: Documents of over HUGE characters are encoded in chunks of CHUNK characters that overlap.
HUGE, CHUNK = 40_000, 16_384
#: Overlaps to try in turn, in characters; where none aligns, the document is encoded whole.
OVERLAPS = (256, 4_096)

_MARKS = "array<struct<a:long,b:long,id:long,k:long>>"
_MARK_ARROW = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("k", pa.int64())]))


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            n = [len(c) // 4 for texts in in_pieces(column_bytes(batch.column("text"))) for c in encoder.ids([t.split() for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def _cut(overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of each text: chunk i has the characters from i * CHUNK on, and `overlap` more than CHUNK."""
        for batch in batches:
            for uid, doc_id, n_bytes, text in zip(*[batch.column(c).to_pylist() for c in ("uid", "doc_id", "n_bytes", "text")], strict=True):
                starts = range(0, max(1, len(text) - overlap), CHUNK) if overlap else [0]
                for i, s in enumerate(starts):
                    last = i == len(starts) - 1
                    piece = text[s:] if last else text[s : s + CHUNK + overlap]
                    columns = [pa.array([uid]), pa.array([doc_id], pa.int64()), pa.array([n_bytes], pa.int64()), pa.array([i], pa.int64()), pa.array([last]), pa.array([piece], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n_bytes", "chunk", "last", "text"])

    return cut


def _marks(text: str, start: int, ids: list[int], spans: list[tuple[int, int]], lo: int, hi: int) -> list[dict]:
    """Tokens within [lo, hi) of the document after which a cut is allowed: place, id and tokens up to there.

    Both ends of the token must lie between characters, and the characters on both sides of the cut must not
    combine under NFC.
    """
    out = []
    for k in range(1, len(ids) - 1):
        (a, b), before, after = spans[k], spans[k - 1][1], spans[k + 1][0]
        if lo <= a + start and b + start < hi and before <= a < b <= after:
            pair = text[b - 1 : b + 1]
            if pair.isascii() or (not unicodedata.combining(pair[-1]) and unicodedata.is_normalized("NFC", pair)):
                out.append({"a": a + start, "b": b + start, "id": ids[k], "k": k + 1})
    return out


def _encode(path: str, overlap: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                text, chunk, last = (row.column(c)[0].as_py() for c in ("text", "chunk", "last"))
                coded = library.encode(text, add_special_tokens=False)
                ids, spans, start = coded.ids, coded.offsets, chunk * CHUNK
                head = _marks(text, start, ids, spans, start, start + overlap) if chunk else []
                tail = [] if last else _marks(text, start, ids, spans, start + CHUNK, start + CHUNK + overlap)
                arrays = [row.column("uid"), row.column("doc_id"), row.column("n_bytes"), row.column("chunk"), row.column("last"), pa.array([len(ids)], pa.int64()), pa.array([head], _MARK_ARROW), pa.array([tail], _MARK_ARROW)]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "doc_id", "n_bytes", "chunk", "last", "n", "head", "tail"])

    return encode


def _spliced(huge: DataFrame, path: str, overlap: int) -> DataFrame:
    """uid, doc_id, n_bytes, n_tokens of each text of `huge`; n_tokens is null where neighbours don't align.

    Where both neighbours have the same token (id and place) in their overlap, the cut after it is stable: what
    stands before it is encoded as in the left chunk, what follows as in the right one, and the token joins them as
    it does in the right one, so no merge reaches over the cut in the whole text either.
    """
    spark = huge.sparkSession
    chunks = huge.mapInArrow(_cut(overlap), "uid long, doc_id long, n_bytes long, chunk long, last boolean, text string").repartition(partitions(spark), "uid", "chunk")
    coded = chunks.mapInArrow(_encode(path, overlap), f"uid long, doc_id long, n_bytes long, chunk long, last boolean, n long, head {_MARKS}, tail {_MARKS}")
    by_doc = Window.partitionBy("uid").orderBy("chunk")
    coded = coded.withColumn("next", F.lead("head").over(by_doc))
    coded = coded.withColumn("left", F.expr("get(filter(tail, t -> exists(next, h -> h.a = t.a and h.b = t.b and h.id = t.id)), 0)"))
    coded = coded.withColumn("right", F.expr("get(filter(next, h -> h.a = left.a and h.b = left.b and h.id = left.id), 0)"))
    upto = F.when(F.col("last"), F.col("n")).otherwise(F.col("left.k"))
    coded = coded.withColumn("part", upto - F.when(F.col("chunk") == 0, 0).otherwise(F.lag("right.k").over(by_doc)))
    whole = F.count("*") == F.count("part")
    return coded.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.when(whole, F.sum("part")).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs.

    The tokenizer must drop white space (see WordEncoder). Texts of over HUGE characters are cut into overlapping
    chunks, dealt out over the cluster, encoded with offsets and spliced at stable common boundaries; where an
    overlap has none it is widened, and at last the text is encoded whole.

    Null text: empty, 0 bytes and tokens. Null ids and repeated rows are rows like others. Empty table: no rows.
    Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done = texts.where(F.length("text") <= HUGE).mapInArrow(_count(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    open_ = saved(texts.where(F.length("text") > HUGE).withColumn("uid", F.monotonically_increasing_id()), "huge-texts")
    for overlap in (*OVERLAPS, 0):
        tried = saved(_spliced(open_, tokenizer_path, overlap), "spliced")
        done = done.unionByName(tried.where("n_tokens is not null").drop("uid"))
        failed = tried.where("n_tokens is null")
        if failed.isEmpty():
            break
        open_ = open_.join(failed.select("uid"), "uid", "left_semi")
    return done.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
