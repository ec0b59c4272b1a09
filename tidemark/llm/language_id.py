"""Language identification by bit-sliced Bloom filters of n-grams (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.cluster import in_python, release, saved
from tidemark.llm.words import U, mix

#: Lengths of the n-grams, in characters of words bounded by one space.
GRAMS = (2, 3, 4)
#: The filters are fitted on about so many labelled documents of each language (all, if fewer), chosen by a hash of
#: their ids; all n-grams of those documents count.
FIT_DOCUMENTS = 2_000
#: A language's filter takes an n-gram whose share there is at least this part of its largest share in any language.
SPECIFIC = 0.1
#: Positions of the filters, at least so many for each n-gram of the language that has most (rounded up to a power of
#: two), and positions that an n-gram sets.
SPREAD, HASHES = 8, 2
#: Documents whose best language explains a smaller part of their n-grams are rejected by the pipeline.
MIN_SCORE = 0.3
#: Characters worked on at once; n-grams over the edge of two pieces count.
PIECE = 1 << 18


@dataclass
class Filters:
    """The languages' Bloom filters, sliced by bit.

    masks[position, i // 8]: bit i % 8 is that position's bit in language i's filter, for any number of languages;
    false_rate[i]: chance that a foreign n-gram passes.
    """

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit codes of all n-grams of the lower-cased letters of a text, other characters being one space."""
    lowered, before = text.lower(), np.array([32], dtype=U)
    for at in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U)
        points = np.where(_letters()[points], points, U(32))
        points = np.concatenate([before, points, [U(32)] if at + PIECE >= len(lowered) else np.zeros(0, dtype=U)])
        points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
        for n in GRAMS:
            new = max(0, len(before) - n + 1)  # n-grams within `before` are counted already
            m = len(points) - n + 1 - new
            if m > 0:
                code = np.full(m, n, dtype=U)
                for k in range(n):
                    code = code * U(0x110003) + points[new + k : new + k + m]
                yield mix(code)
        before = points[-(max(GRAMS) - 1) :]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    totals: dict[str, dict] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            kept = totals.setdefault(lang, {"codes": [], "size": 0})
            for codes in grams(text.as_py() or ""):
                kept["codes"].append(np.unique(codes, return_counts=True))
                kept["size"] += len(kept["codes"][-1][0])
            if kept["size"] > 1 << 20:
                yield _merged(lang, totals.pop(lang)["codes"])
    for lang, kept in totals.items():
        if kept["codes"]:
            yield _merged(lang, kept["codes"])


def _merged(lang: str, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id") -> Filters:
    """Filters from rows (id, text, lang) with a language; see FIT_DOCUMENTS for the bound on rows.

    A filter takes the n-grams whose share in its language is at least SPECIFIC of their largest share in any. What
    reaches the driver is the model: the n-grams of the sampled documents and a row for each language.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((1, 1), dtype=np.uint8), np.zeros(0))
    of = labelled.sparkSession.createDataFrame([(lang, i, min(1.0, FIT_DOCUMENTS / sizes[lang])) for i, lang in enumerate(languages)], "__lang string, i int, part double")
    place = (F.xxhash64(F.lit("language sample"), F.col(id_col)).cast("double") / float(1 << 63) + 1) / 2
    chosen = labelled.join(F.broadcast(of), F.col("lang") == F.col("__lang")).where(place <= F.col("part")).select("lang", "text")
    counts = in_python(chosen, _gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = saved(counts, "language-grams")
    totals = counts.groupBy(F.col("lang").alias("__of")).agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), F.col("lang") == F.col("__of")).withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy(F.col("gram").alias("__gram")).agg(F.max("share").alias("best"))
    shares = shares.join(best, F.col("gram") == F.col("__gram")).where(F.col("share") >= SPECIFIC * F.col("best"))
    model = shares.join(F.broadcast(of), F.col("lang") == F.col("__lang")).select("i", "gram").toArrow()
    return built(languages, model["i"].to_numpy(), model["gram"].to_numpy().view(U))


def built(languages: list[str], of: np.ndarray, codes: np.ndarray) -> Filters:
    """Filters that hold n-gram codes[j] for language of[j]."""
    most = int(np.bincount(of, minlength=1).max(initial=1))
    masks = np.zeros((1 << (SPREAD * most - 1).bit_length(), (len(languages) + 7) // 8), dtype=np.uint8)
    filled = np.zeros(len(languages))
    for i in range(len(languages)):
        for at in _positions(codes[of == i], len(masks)):
            masks[at, i // 8] |= np.uint8(1 << i % 8)
        filled[i] = (masks[:, i // 8] >> np.uint8(i % 8) & np.uint8(1)).mean()
    return Filters(languages, masks, filled**HASHES)


def _positions(codes: np.ndarray, positions: int) -> list[np.ndarray]:
    return [(mix(codes + U(k)) & U(positions - 1)).astype(np.int64) for k in range(HASHES)]


def scores(text: str | None, filters: Filters) -> np.ndarray | None:
    """For each language the part of the text's n-grams that its filter holds, less what passes by chance; None without letters."""
    found, n = np.zeros(len(filters.languages), dtype=np.int64), 0
    for every in grams(text or ""):
        for at in range(0, len(every), 1 << 16):
            codes = every[at : at + (1 << 16)]
            first, *rest = _positions(codes, len(filters.masks))
            passed = filters.masks[first]
            for p in rest:
                passed = passed & filters.masks[p]  # a bit for each language that has the n-gram
            found += np.unpackbits(passed, axis=1, bitorder="little")[:, : len(found)].sum(axis=0, dtype=np.int64)
            n += len(codes)
    if not n or not len(found):
        return None
    return np.clip((found / n - filters.false_rate) / (1 - filters.false_rate), 0, 1)


def _predict(filters: Filters, inside: str | None = None):
    """Adds lang_pred and score by the column text and passes the others through, or by the field text of the struct `inside`, passed through as it is."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names, values = [], []
            for text in batch.column("text") if inside is None else pc.struct_field(batch.column(inside), "text"):
                found = scores(text.as_py(), filters)
                best = -1 if found is None else int(found.argmax())
                names.append("und" if best < 0 else filters.languages[best])
                values.append(0.0 if best < 0 else float(found[best]))
            rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*[batch.schema.names[i] for i in rest], "lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for testing: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    Filters are fitted on the labelled rows that are not held out, unless given. Every n-gram of a text is looked up
    at once in all languages' Bloom filters, sliced by bit; each language's count, corrected for false positives,
    is its score, and the highest decides (ties: the first in code point order).

    Null text, or one without a letter: `und`, score 0; so is everything if no row is labelled. A null id is not
    held out. Repeated rows are rows like others. Empty table: no rows. Any number of languages; very long texts
    are read piece by piece. Other columns, and those of the label and the source, are never read for a prediction.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    filters = filters or fit(texts.where("not held_out"))
    out = in_python(texts.select("doc_id", "held_out", "text"), _predict(filters), "doc_id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", id_col)


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) whose language is recognised with at least min_score.

    A row is judged by its text alone: null texts and those without a letter go, equal texts share their fate, and
    repeated rows stay repeated. All columns are passed on as they are, whatever their names. Empty table: no rows.
    If no row outside the held-out ones has a language, nothing is recognised. Ties go to the first language.
    """
    filters = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    schema = StructType([StructField("row", docs.schema), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    marked = in_python(docs.select(F.struct("*").alias("row")), _predict(filters, "row"), schema)
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("row.*")
