"""Phrase collocations from depth-limited count tries (operator 12)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import partitions, saved, small
from tidemark.llm.words import _LOWER, U, _hash_piece, column_bytes, mix

#: Longest phrase; least number of occurrences of a candidate; percentage of a candidate's occurrences in a longer one that drops it.
DEPTH, LEAST, COVERED = 3, 10, 50
#: Scores are floor(SCALE * a * a / (l * r)); so many candidates of each language are returned.
SCALE, TOP = 1_000_000, 2_000
#: A trie is built of about so many bytes of text of one language; a task holds so many bytes of all languages.
TRIE_BYTES, HELD_BYTES = 6 << 20, 12 << 20
#: Tries are cut into prefix ranges, one for each so many bytes of all texts, and no fewer than shuffle partitions.
RANGE_BYTES = 8 << 20
#: Candidates of a language are ranked in so many parts first.
PARTS = 32

_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\r\x0b\x0c.,;:!?")] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b"\n\r\x0b\x0c.,;:!?")] = True
_CUT = re.compile(rb"[ \t-\r.,;:!?]")
_AHEAD = re.compile(rb"(?:[ \t-\r.,;:!?]*[^ \t-\r.,;:!?]+){0,%d}" % (DEPTH - 1))
_CODEC = pa.Codec("zstd", compression_level=1)
_SHARD = "lang string, range int, words binary, levels binary"
_SPREAD = U(0x9E3779B97F4A7C15)


def _parts(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about `size` bytes, cut between words: each with the words ahead that its last phrases need, and where its own words end."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : _AHEAD.match(text, cut.start()).end()], cut.start() - at
        at = cut.start()
    yield text[at:], len(text) - at


def _words(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the id of each word of the text, where it starts, and the number of breaks before it."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~_BLANK[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    if not len(edges):
        return pa.array([], pa.binary()), *[np.zeros(0, dtype=np.int64)] * 3
    every = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])  # words and what is between them by turns
    coded = every.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
    starts = edges[::2].astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, np.cumsum(_BREAK[raw], dtype=np.int64)[starts]


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; words hold no white space."""
    return _hash_piece(b" ".join(words.to_pylist()))[1]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, and their counts."""
    return np.unique(keys, return_inverse=True, return_counts=True)


class Trie:
    """A count trie as sorted levels: nodes of level k have the number of their parent in level k - 1, a word id and a count."""

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def of(cls, parts: list[tuple[bytes, int]]) -> Trie:
        """The trie of texts; of each part only phrases that begin before its second value are counted."""
        data, own, at = b"\n".join(text for text, _ in parts).translate(_LOWER), [], 0
        words, ids, starts, breaks = _words(data)
        for text, end in parts:
            own.append((at, at + end))
            at += len(text) + 1
        counts = np.zeros(len(starts) + 1, dtype=np.int64)
        for a, b in np.searchsorted(starts, np.array(own)) if len(own) else []:
            counts[a] += 1
            counts[b] -= 1
        here = np.flatnonzero(np.cumsum(counts[:-1]) > 0)
        levels, parent = [], np.zeros(len(here), dtype=np.int64)
        for k in range(DEPTH):
            if k:  # the word k places on, within the piece
                fits = here + k < len(ids)
                here, parent = here[fits], parent[fits]
                same = breaks[here] == breaks[here + k]
                here, parent = here[same], parent[same]
            nodes, parent, n = _counted(parent * max(len(words), 1) + ids[here + k])
            levels.append((nodes // max(len(words), 1), nodes % max(len(words), 1), n))
        return cls(words, levels)

    def cut(self, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
        """The trie in prefix ranges, by the hash of a node's first word (level 1) or first two words, each as (range, words, nodes)."""
        hashes = _hashes(self.words)
        ends = [(U(0xFFFFFFFFFFFFFFFF) // U(ranges) + U(1)) * U(i) for i in range(1, ranges)]
        first, second, third = self.levels
        top = hashes[first[1]]
        pair = mix(top[second[0]] * _SPREAD + hashes[second[1]])
        by_level = []
        for h in (top, pair, pair[third[0]]):
            place = np.searchsorted(np.array(ends, dtype=U), h, side="right")
            order = np.argsort(place, kind="stable")
            by_level.append((order, np.searchsorted(place[order], np.arange(ranges + 1))))
        for r in range(ranges):
            one, two, three = (order[bounds[r] : bounds[r + 1]] for order, bounds in by_level)
            if not (len(one) or len(two) or len(three)):
                continue
            paths = [
                np.stack([first[1][one]]), np.stack([first[1][second[0][two]], second[1][two]]),
                np.stack([first[1][second[0][third[0][three]]], second[1][third[0][three]], third[1][three]]),
            ]
            used = np.unique(np.concatenate([p.ravel() for p in paths]))
            counts = (first[2][one], second[2][two], third[2][three])
            yield r, _packed_words(self.words.take(pa.array(used))), _packed_levels([np.searchsorted(used, p) for p in paths], counts)


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unzip(data: bytes) -> memoryview:
    return memoryview(_CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def _packed_words(words: pa.Array) -> bytes:
    return _zip(b" ".join(words.to_pylist()))


def _packed_levels(paths: list[np.ndarray], counts: tuple[np.ndarray, ...]) -> bytes:
    """Level by level: number of nodes, steps of the first word id, the other word ids, counts."""
    out = []
    for path, n in zip(paths, counts, strict=True):
        order = np.lexsort(path[::-1])
        path = path[:, order].astype("<i4")
        out += [np.array([len(n)], "<i8").tobytes(), np.diff(path[0], prepend=np.int32(0)).tobytes(), path[1:].tobytes(), n[order].astype("<i8").tobytes()]
    return _zip(b"".join(out))


def _unpacked_levels(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    view, at = _unzip(data), 0
    for k in range(1, DEPTH + 1):
        n = int(np.frombuffer(view, "<i8", 1, at)[0])
        path = np.frombuffer(view, "<i4", n * k, at + 8).reshape(k, n).astype(np.int64)
        path[0] = np.cumsum(path[0])
        at += 8 + 4 * k * n
        yield path, np.frombuffer(view, "<i8", n, at)
        at += 8 * n


def _shards(ranges: int):
    """Rows of _SHARD for batches of (lang, text): the tries of a task's texts, language by language, in prefix ranges."""

    def built(lang: str, parts: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        rows = list(Trie.of(parts).cut(ranges))
        columns = [pa.array([lang] * len(rows)), pa.array([r for r, *_ in rows], pa.int32()), pa.array([w for _, w, _ in rows], pa.binary()), pa.array([n for *_, n in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "range", "words", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple[bytes, int]]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), column_bytes(batch.column("text")), strict=True):
                for part in _parts(text, TRIE_BYTES):
                    parts.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part[0]) + 64
                    most = max(sizes, key=sizes.get) if sum(sizes.values()) > HELD_BYTES else lang
                    if sizes[most] > TRIE_BYTES or most != lang:
                        del sizes[most]
                        yield from built(most, parts.pop(most))
        for lang in list(parts):
            yield from built(lang, parts.pop(lang))

    return run


def _merged(shards: list[tuple[bytes, bytes]], least: int) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]], int]:
    """One prefix range of all tries: its words, for each level the paths (as word ids) and counts of nodes with `least` or more, and the number of words counted."""
    lists = [pa.array(bytes(_unzip(w)).split(b" "), pa.binary()) for w, _ in shards]
    coded = pa.concat_arrays(lists).dictionary_encode()
    words, ids = coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(x) for x in lists])[:-1])
    levels = [[(own[path], n) for path, n in _unpacked_levels(data)] for own, (_, data) in zip(ids, shards, strict=True)]
    out, total = [], 0
    for k in range(DEPTH):
        path = np.concatenate([x[k][0] for x in levels], axis=1)
        n = np.concatenate([x[k][1] for x in levels])
        node = path[0]
        for word in path[1:]:  # numbered prefixes, so that a key fits 64 bits
            node = np.unique(node, return_inverse=True)[1] * len(words) + word
        order = np.argsort(node, kind="stable")
        begins = np.flatnonzero(np.diff(node[order], prepend=-1))
        sums = np.add.reduceat(n[order], begins) if len(begins) else n[:0]
        total += int(sums.sum()) if k == 0 else 0
        keep = sums >= least
        out.append((path[:, order[begins[keep]]], sums[keep]))
    return words, out, total


def _merger(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shards = list(zip(table.column("words").to_pylist(), table.column("levels").to_pylist(), strict=True))
        words, levels, total = _merged(shards, least)
        text, lang = words.cast(pa.string()), key[0].as_py()
        columns: list[list] = [[pa.nulls(1, pa.string())] for _ in range(DEPTH)]
        for path, n in levels:
            for k in range(DEPTH):
                columns[k].append(text.take(pa.array(path[k])) if k < len(path) else pa.nulls(len(n), pa.string()))
        counts = pa.array(np.concatenate([[total], *[n for _, n in levels]]), pa.int64())
        return pa.table([pa.array([lang] * len(counts), pa.string()), *[pa.concat_arrays(c) for c in columns], counts], names=["lang", "w1", "w2", "w3", "n"])

    return run


def tries(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, w1, w2, w3, n for docs (lang, text): the nodes of all tries merged that have `least` occurrences or more; w1 null: occurrences of all words in a range."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    ranges = max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    shards = saved(docs.select("lang", "text").mapInArrow(_shards(ranges), _SHARD), "phrase-tries", "none")
    return shards.groupBy("lang", "range").applyInArrow(_merger(least), "lang string, w1 string, w2 string, w3 string, n long")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows with path p1, p2, p3 the counts of their prefixes of one and two words (up1, up2); null for those in an earlier partition."""
    held: list[tuple | None] = [None, None]
    for batch in batches:
        lang, p1, p2, p3, n = (batch.column(c).to_pylist() for c in ("lang", "p1", "p2", "p3", "n"))
        up1, up2 = [], []
        for at, a, b, c, count in zip(lang, p1, p2, p3, n, strict=True):
            if b is None:
                held = [(at, a, count), None]
            elif c is None:
                held[1] = (at, a, b, count)
            up1.append(held[0][-1] if b is not None and held[0] and held[0][:-1] == (at, a) else None)
            up2.append(held[1][-1] if c is not None and held[1] and held[1][:-1] == (at, a, b) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(up1, pa.int64()), pa.array(up2, pa.int64())], names=[*batch.schema.names, "up1", "up2"])


def _with_prefixes(nodes: DataFrame, path: list, up: list[str], name: str) -> DataFrame:
    """nodes with the counts of the prefixes of `path` (three columns, null beyond the phrase) as columns `up`.

    The nodes are sorted by path over all partitions and walked; where a range begins inside a prefix, that prefix is
    looked up: two for each partition at most.
    """
    spark, keys = nodes.sparkSession, ["lang", "p1", "p2", "p3"]
    rows = nodes.withColumns(dict(zip(keys[1:], path, strict=True))).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    walked = saved(rows.mapInArrow(_walk, f"{schema}, up1 long, up2 long"), name)
    lost1 = walked.where("p2 IS NOT NULL AND up1 IS NULL").select("lang", "p1", F.lit(None).cast("string").alias("p2"))
    lost2 = walked.where("p3 IS NOT NULL AND up2 IS NULL").select("lang", "p1", "p2")
    lost = small(lost1.union(lost2).distinct().toDF("__l", "__a", "__b"), f"{name}-cut")
    same = (F.col("lang") == F.col("__l")) & (F.col("p1") == F.col("__a")) & F.col("p2").eqNullSafe(F.col("__b"))
    fences = small(walked.where("p3 IS NULL").join(lost, same, "left_semi").select("lang", "p1", "p2", "n").toDF("__l", "__a", "__b", "__n"), f"{name}-fences")
    known = F.col("p2").isNull() | (F.col("up1").isNotNull() & (F.col("p3").isNull() | F.col("up2").isNotNull()))
    one, two = (fences.where(F.col("__b").isNull()).select("__l", "__a", F.col("__n").alias("__n1")), fences.where(F.col("__b").isNotNull()).select("__l", "__a", "__b", F.col("__n").alias("__n2")))
    below = (F.col("lang") == F.col("__l")) & (F.col("p1") == F.col("__a"))
    filled = walked.where(~known).join(one, below, "left").drop("__l", "__a").join(two, below & (F.col("p2") == F.col("__b")), "left")
    filled = filled.select(*nodes.columns, F.coalesce("up1", "__n1").alias("up1"), F.when(F.col("p3").isNotNull(), F.coalesce("up2", "__n2")).alias("up2"))
    return walked.where(known).select(*nodes.columns, "up1", "up2").union(filled).withColumnsRenamed({"up1": up[0], "up2": up[1]})


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 3 words.

    Texts (A-Z lower-cased) are split at . , ; : ! ? and line breaks (\\n-\\r) into pieces and those at space and tab into
    words; phrases lie within pieces. a, l, r: occurrences of the phrase, of its first part and of the rest, at the cut
    (after the first words, fewest first) that scores lowest by floor(SCALE * a * a / (l * r)); n: all words of the
    language. Of phrases with `least` occurrences or more those go that lie in a longer one with at least COVERED percent of
    their occurrences.

    1. Each task counts the phrases of its texts in tries of depth 3, cut into prefix ranges and serialised sorted.
    2. A range's tries are merged; only nodes with `least` occurrences or more go on, as parts of a candidate have no fewer.
    3. A walk over the nodes sorted by path gives the left parts, ancestors in the trie. The right parts are what suffix
       links lead to: ancestors in the trie of the reversed paths, which a second walk gives.

    Null text: no words. Null language: `und`. Repeated rows count each time. Null ids and other columns don't matter.
    Empty table: no rows. A very long text is counted in parts that overlap by two words.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    merged = saved(tries(rows, least), "phrase-nodes")
    totals = small(merged.where("w1 IS NULL").groupBy(F.col("lang").alias("__of")).agg(F.sum("n").alias("__words")), "phrase-words")
    nodes = merged.where("w1 IS NOT NULL")
    nodes = _with_prefixes(nodes, [F.col("w1"), F.col("w2"), F.col("w3")], ["l1", "l2"], "phrase-left")
    nodes = _with_prefixes(nodes, [F.coalesce("w3", "w2", "w1"), F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1")), F.when(F.col("w3").isNotNull(), F.col("w1"))], ["r1", "r2"], "phrase-right")
    # The score of a cut: exact in decimals of 38 digits up to 10**16 occurrences.
    score = lambda left, right: F.expr(f"CAST(CAST({SCALE} AS DECIMAL(7,0)) * CAST(n AS DECIMAL(15,0)) * CAST(n AS DECIMAL(15,0)) AS DECIMAL(38,0)) DIV (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))")
    option = lambda left, right, k: F.struct(score(left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    best = F.when(F.col("w3").isNull(), option("l1", "r1", 1)).otherwise(F.least(option("l1", "r2", 1), option("l2", "r1", 2)))
    scored = saved(nodes.where("w2 IS NOT NULL").withColumn("best", best).select("lang", "w1", "w2", "w3", F.col("n").alias("a"), "best.l", "best.r", "best.score"), "phrase-scores")
    longer = scored.where("w3 IS NOT NULL").select(F.col("lang").alias("__l"), "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.groupBy("__l", F.col("p.w1").alias("__a"), F.col("p.w2").alias("__b")).agg(F.max("a").alias("__most"))
    same = (F.col("lang") == F.col("__l")) & (F.col("w1") == F.col("__a")) & (F.col("w2") == F.col("__b")) & F.col("w3").isNull()
    kept = scored.join(longer, same, "left").where(f"__most IS NULL OR 100 * __most < {COVERED} * a")
    kept = kept.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    kept = kept.withColumn("__i", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("__i") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    joined = kept.join(totals, F.col("lang") == F.col("__of"))
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("__words").alias("n"), "score")
