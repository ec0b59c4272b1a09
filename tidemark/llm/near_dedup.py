"""MinHash near-duplicates by a multi-index Hamming join (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import in_python, release, saved, small
from tidemark.llm.graph import components
from tidemark.llm.words import U, column_bytes, mix, shingle_sets

#: A signature is CHUNKS chunks of SLOTS MinHash values of BITS bits; a chunk fills one long.
CHUNKS, SLOTS, BITS = 14, 4, 16
#: Errors allowed in a chunk. Pairs with up to DISTANCE differing values share a chunk with at most that many.
ERRORS = 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Buckets of more classes than this are crowded: their classes' shingles are counted and mapped to MAP_WORDS words of 64
#: bits to bound similarities, which never drops a pair that reaches the similarity.
CROWD, MAP_WORDS = 8, 16
#: Buckets of more members than HOT meet their leader by broadcast, so that no task holds them; strangers and members of
#: crowded buckets are compared in blocks of about BLOCK, each pair of blocks by itself.
HOT, BLOCK = 4_096, 512
#: Link: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 63, CHUNKS * SLOTS, dtype=U)
_MUL = _RNG.integers(0, 1 << 63, CHUNKS * SLOTS, dtype=U) * U(2) + U(1)
_LANES = (0, 1, 2, 3)
_CHUNK_COLUMNS = [f"s{i}" for i in range(CHUNKS)]
_NIBBLE_COLUMNS = [f"q{i}" for i in range(-(-CHUNKS // 4))]
_MAP_COLUMNS = [f"m{i}" for i in range(MAP_WORDS)]
_PLACE = (U(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F)


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS longs, each holding SLOTS values of BITS bits: scrambled minima under CHUNKS * SLOTS hash orders."""
    least = np.full(CHUNKS * SLOTS, ~U(0), dtype=U)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    values = (mix(least) >> U(48)).reshape(CHUNKS, SLOTS)
    return (values << (U(BITS) * np.arange(SLOTS, dtype=U))).sum(axis=1, dtype=U)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        sizes, digests, signs = [], [], []
        for s in shingle_sets(column_bytes(batch.column("text"))):
            sizes.append(len(s))
            digests.append(np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64))
            signs.append(signature(s) if len(s) else np.zeros(CHUNKS, dtype=U))
        digest = np.array(digests, dtype=np.int64).reshape(-1, 2)
        sign = np.array(signs, dtype=U).reshape(-1, CHUNKS).view(np.int64)
        columns = [batch.column("doc_id"), batch.column("uid"), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(sign[:, i]) for i in range(CHUNKS)], names=["doc_id", "uid", "n", "d1", "d2", *_CHUNK_COLUMNS])


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk, one key for each way to leave ERRORS = 1 of its values out; ways are numbered along the signature."""
    for batch in batches:
        cid = batch.column("cid")
        for i in range(CHUNKS):
            chunk = batch.column(f"s{i}").to_numpy(zero_copy_only=False).view(U)
            for lane in _LANES:
                key = mix((chunk & ~(U(0xFFFF) << U(BITS * lane))) * _PLACE[0] + U((i * SLOTS + lane + 1) * _PLACE[1] % (1 << 64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), cid, pa.array(np.full(len(key), i * SLOTS + lane, dtype=np.int8))], names=["key", "cid", "way"])


def _unequal(x: Column) -> Column:
    """The number of values that differ between two chunks, given what they differ in (x)."""
    for shift in (8, 4, 2, 1):  # gathers all bits of a value in its lowest one
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))


def _differing(a: str, b: str) -> list[Column]:
    """For each chunk the number of its values that differ between the rows a and b."""
    return [_unequal(F.expr(f"{a}.{c} ^ {b}.{c}")) for c in _CHUNK_COLUMNS]


def _first_shared(a: str, b: str) -> Column:
    """Whether the bucket (`way`) in which two rows with the chunks of their signatures as `sign` meet is the first that they share.

    They share one of a chunk's buckets if one of its values differs, and all if none does.
    """
    sign = lambda side: F.col(f"{side}.sign")
    chunk = F.floor(F.col(f"{a}.way") / SLOTS).cast("int")
    earlier = F.zip_with(F.slice(sign(a), F.lit(1), chunk), F.slice(sign(b), F.lit(1), chunk), lambda s, t: s.bitwiseXOR(t))
    first = (F.col(f"{a}.way") % SLOTS == 0) | (F.element_at(sign(a), chunk + 1) != F.element_at(sign(b), chunk + 1))
    return first & ~F.exists(earlier, lambda x: _unequal(x) <= ERRORS)


def _nibbles() -> list[Column]:
    """The lowest four bits of a signature's values, those of four chunks in a word."""
    lowest = [F.col(c).bitwiseAND(F.lit(0x000F000F000F000F)) for c in _CHUNK_COLUMNS]
    words = [[F.shiftleft(c, 4 * k) for k, c in enumerate(lowest[i : i + 4])] for i in range(0, CHUNKS, 4)]
    return [reduce(Column.bitwiseOR, w).alias(c) for w, c in zip(words, _NIBBLE_COLUMNS, strict=True)]


def _nibbles_near(a: str, b: str) -> Column:
    """Whether at most DISTANCE values differ in their lowest bits, as those of any pair within DISTANCE; a short test for a join."""
    out = []
    for c in _NIBBLE_COLUMNS:
        x = F.expr(f"{a}.{c} ^ {b}.{c}")
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        out.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(add, out) <= DISTANCE


def _may_link(a: str, b: str) -> Column:
    """Set sizes that allow the similarity, and a signature distance within DISTANCE."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * SIMILARITY) & (reduce(add, _differing(a, b)) <= DISTANCE)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """cid and shingle sets of the rows (cid, text), about 260,000 shingles at a time."""
    for batch in batches:
        cids, at, sets, size = batch.column("cid").to_numpy(zero_copy_only=False), 0, [], 0
        for s in shingle_sets(column_bytes(batch.column("text"))):
            sets.append(s)
            size += len(s)
            if size > 1 << 18:
                yield cids[at : at + len(sets)], sets
                at, sets, size = at + len(sets), [], 0
        yield cids[at : at + len(sets)], sets


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cids, sets in _in_parts(batches):
        offsets = pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32())
        items = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, dtype=U), *sets]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(cids), items], names=["cid", "items"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cids, sets in _in_parts(batches):
        if sets:
            every = np.repeat(cids, [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.concatenate(sets).view(np.int64))], names=["cid", "shingle"])


def shingle_map(shingles: np.ndarray) -> np.ndarray:
    """MAP_WORDS words of 64 bits, with the bit of each shingle's hash set."""
    bits = np.zeros(64 * MAP_WORDS, dtype=np.uint8)
    bits[(mix(shingles) % U(64 * MAP_WORDS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cids, sets in _in_parts(batches):
        words = np.array([shingle_map(s) for s in sets], dtype=np.int64).reshape(-1, MAP_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(cids), *[pa.array(words[:, i]) for i in range(MAP_WORDS)]], names=["cid", *_MAP_COLUMNS])


def _rare(crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """owners: the classes (ascending) that have a shingle which one to three texts of `crowd` (cid, __uid) have; a row a shingle."""
    found = in_python(docs.join(crowd, F.col("uid") == F.col("__uid")).select("cid", "text"), _shingles, "cid long, shingle long")
    owners = found.groupBy("shingle").agg(F.count("*").alias("n"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.bit_xor("cid").alias("x")).where("n <= 3")
    third = F.when(F.col("n") == 3, F.expr("x ^ lo ^ hi")).otherwise(F.col("lo"))
    return owners.select(F.array_sort(F.array_distinct(F.array("lo", third, "hi"))).alias("owners"))


def _bound(a: str, b: str) -> Column:
    """Whether two classes of a crowded bucket, without a rare shingle in common, can reach the similarity.

    They share at most what either has of shingles that aren't rare (`plain`). Each bit that one's map has and the
    other's lacks is a shingle of its own, so they also share at most the bits in common and what either has of
    shingles beyond its bits (`beyond`).
    """
    col = lambda side, c: F.col(f"{side}.{c}")
    bits = reduce(add, [F.bit_count(col(a, m).bitwiseAND(col(b, m))) for m in _MAP_COLUMNS])
    most = F.least(col(a, "plain"), col(b, "plain"), F.least(col(a, "beyond"), col(b, "beyond")) + bits)
    return (100 + SIMILARITY) * most >= SIMILARITY * (col(a, "n") + col(b, "n"))


def _one_each(table: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The saved table with one row for each cid; rows of documents that repeat id and text come more than once."""
    return saved(table.dropDuplicates(["cid"]), name) if table.count() > wanted.count() else table


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the saved pairs (a, b) of class ids that meet the similarity, by their full shingle sets."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    needed = small(classes.join(needed, F.col("cid") == F.col("id"), "left_semi").select("cid", F.col("uid").alias("__uid")), "dedup-needed")
    sets = in_python(docs.join(needed, F.col("uid") == F.col("__uid")).select("cid", "text"), _sets, "cid long, items array<long>")
    sets = _one_each(saved(sets, "dedup-sets"), needed, "dedup-single-sets")
    left, right = sets.toDF("ca", "xs"), sets.toDF("cb", "ys")
    both = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb"))
    common = F.size(F.array_intersect("xs", "ys")).cast("long")
    return both.where(100 * common >= SIMILARITY * (F.size("xs") + F.size("ys") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _led(keys: DataFrame, leaders: DataFrame) -> DataFrame:
    """keys with the leader of their bucket, where it has more members than one; leaders is a saved table."""
    hot = small(leaders.where(F.col("members") > HOT), "dedup-hot")
    if hot.isEmpty():
        return keys.join(leaders, F.col("key") == F.col("__key"))
    rest = keys.join(hot, F.col("key") == F.col("__key"), "left_anti").join(leaders.where(F.col("members") <= HOT), F.col("key") == F.col("__key"))
    return keys.join(hot, F.col("key") == F.col("__key")).unionByName(rest)


def _mixed(labelled: DataFrame, name: str) -> DataFrame:
    """The buckets (__key) with more than one label: their members, the label that most have (main) and the number of strangers to it; saved."""
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy(F.col("key").alias("__key")).agg(F.sum("n").alias("members"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
    return saved(mixed.select("__key", "members", F.col("top.label").alias("main"), (F.col("members") - F.col("top.n")).alias("strangers")), name)


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strangers (members outside their bucket's main label) and all members as sides that meet by (key, i, j), blocks of strangers and of members."""
    strangers, every = F.ceil(F.col("strangers") / BLOCK), F.ceil(F.col("members") / BLOCK)
    place = lambda of: F.pmod(F.xxhash64("cid"), of).cast("int")
    copies = lambda of: F.explode(F.sequence(F.lit(0), (of - 1).cast("int")))
    left = members.where("label != main").select("*", place(strangers).alias("i"), copies(every).alias("j"))
    return left, members.select("*", place(every).alias("j"), copies(strangers).alias("i"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, uid (a hash of id and text).

    Two rows are linked if their sets of distinct five-word shingles (A-Z lower-cased, words split at space and
    \\t-\\r) have a Jaccard similarity of 0.75 or more; component_id is the least id that links lead to.

    1. Rows with equal sets form a class, which goes on as one.
    2. Classes whose signatures agree on all but one value of a chunk meet in a bucket. Every pair within
       DISTANCE = 27 of 56 values meets in one (at similarity 0.75 a pair is further apart with a probability of 4.9e-5).
    3. In each bucket all members are compared with the least one; links are confirmed on full sets and joined to
       components, so that a group of near copies costs one comparison a member and bucket.
    4. Then all pairs of a bucket that are still in different components are compared, in the first bucket they share.
       In crowded buckets rare shingles, which three texts of all crowds have at most, and bit maps of the sets bound
       what two classes without a rare one in common can share; pairs with one are listed by it. So a copy changed so
       much that it left its group, whose new shingles hardly anyone has, isn't confirmed against all the others, nor
       paired if it has too many of them for any link. The join tests the signatures' lowest bits too and makes each pair once. Only
       members outside a bucket's largest component meet the rest, so a group of a million and one stranger costs a
       million tests; both sides are dealt to blocks, and each pair of blocks is a group of its own.

    No words, empty or null text: an empty set, n_shingles 0, linked with nothing. Rows equal in id and text get
    equal results. A null id takes part, but names no component unless all ids of it are null (component_id is
    null then). kept: the id is the component's (null-safe). Empty table: no rows. Other columns are ignored. Very long
    texts are hashed piece by piece; a text's set of shingles is held as a whole where it is compared.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    chunk_schema = ", ".join(f"{c} long" for c in _CHUNK_COLUMNS)
    rows = saved(in_python(docs, _sign, f"doc_id long, uid long, n long, d1 long, d2 long, {chunk_schema}"), "dedup-signatures")
    found = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("uid").alias("uid"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in _CHUNK_COLUMNS])
    found = saved(found, "dedup-sets-of-rows")
    # A class goes by its least id; where classes share that (an id with several texts), all but one by their digest.
    first = found.groupBy(F.col("rep").alias("__rep")).agg(F.min("d1").alias("__first"))
    own = F.when(F.col("rep").isNotNull() & (F.col("d1") == F.col("__first")), F.col("rep")).otherwise(F.expr("-abs(d1 div 2) - 1"))
    classes = saved(found.join(first, F.col("rep") == F.col("__rep"), "left").withColumn("cid", own).drop("__rep", "__first"), "dedup-classes")

    keys = in_python(classes.select("cid", *_CHUNK_COLUMNS), _chunk_keys, "key long, cid long, way byte")
    leaders = saved(keys.groupBy(F.col("key").alias("__key")).agg(F.min("cid").alias("leader"), F.count("*").alias("members")).where("members > 1"), "dedup-leaders")
    buckets = saved(_led(keys, leaders).select("key", "way", "cid", "leader", "members"), "dedup-buckets")

    side = classes.select("cid", "n", *_CHUNK_COLUMNS)
    stars = buckets.where("cid != leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    stars = stars.join(side.alias("x"), F.col("a") == F.col("x.cid")).join(side.alias("y"), F.col("b") == F.col("y.cid"))
    stars = saved(stars.where(_may_link("x", "y")).select("a", "b"), "dedup-stars")
    links = saved(_confirmed(stars, classes, docs), "dedup-links")
    joined = saved(components(links), "dedup-components")

    labels = small(joined, "dedup-labels")
    labelled = buckets.join(labels, F.col("cid") == F.col("node"), "left").select("key", "way", "cid", "members", F.coalesce("root", "cid").alias("label"))
    labelled = saved(labelled, "dedup-labelled")
    open_ = saved(_led(labelled.drop("members"), _mixed(labelled, "dedup-mixed-keys")).drop("__key").withColumn("crowded", F.col("members") > CROWD), "dedup-mixed")
    crowd = open_.where("crowded").select(F.col("cid").alias("__in")).distinct()
    crowd = small(classes.join(crowd, F.col("cid") == F.col("__in"), "left_semi").select("cid", F.col("uid").alias("__uid")), "dedup-crowd")
    rare = saved(_rare(crowd, docs), "dedup-rare")
    maps = in_python(docs.join(crowd, F.col("uid") == F.col("__uid")).select("cid", "text"), _maps, "cid long, " + ", ".join(f"{m} long" for m in _MAP_COLUMNS))
    maps = _one_each(saved(maps, "dedup-maps"), crowd, "dedup-single-maps").withColumnRenamed("cid", "__mc")
    burden = small(rare.select(F.explode("owners").alias("__rc")).groupBy("__rc").agg(F.count("*").alias("rare")), "dedup-burden")
    calm = open_.where("not crowded").join(side.withColumnRenamed("cid", "__cid"), F.col("cid") == F.col("__cid")).drop("__cid")
    x, y = calm.alias("x"), calm.alias("y")
    first_shared = reduce(and_, [(d > ERRORS) | (F.lit(i * SLOTS + SLOTS) > F.col("x.way")) for i, d in enumerate(_differing("x", "y"))])
    apart = (F.col("x.cid") < F.col("y.cid")) & (F.col("x.label") != F.col("y.label"))
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _may_link("x", "y") & first_shared).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    bits = reduce(add, [F.bit_count(m) for m in _MAP_COLUMNS])
    known = classes.select("cid", "n", *_CHUNK_COLUMNS).join(maps, F.col("cid") == F.col("__mc")).join(burden, F.col("cid") == F.col("__rc"), "left")
    known = known.select(F.col("cid").alias("__cid"), "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("plain"), (F.col("n") - bits).alias("beyond"), *_MAP_COLUMNS, *_nibbles(), F.array(*_CHUNK_COLUMNS).alias("sign"))
    # Without a rare shingle in common a class shares no more than its plain ones, and a link takes SIMILARITY percent of its own set.
    able = saved(known.where(100 * F.col("plain") >= SIMILARITY * F.col("n")), "dedup-able")
    thronged = saved(open_.where("crowded").select("key", "way", "cid", "label").join(able, F.col("cid") == F.col("__cid")).drop("__cid"), "dedup-open")
    thronged = _led(thronged, _mixed(thronged, "dedup-open-keys")).drop("__key")
    x, y = (side_.alias(name) for name, side_ in zip("xy", _sides(thronged), strict=True))
    met = reduce(and_, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")])
    once = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid")))
    bounded = x.join(y, met & once & _nibbles_near("x", "y") & _bound("x", "y") & _first_shared("x", "y")).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    by_rare = rare.where("size(owners) > 1").select(F.expr("explode(filter(array(struct(owners[0] AS a, owners[1] AS b), struct(owners[0] AS a, get(owners, 2) AS b), struct(owners[1] AS a, get(owners, 2) AS b)), p -> p.b IS NOT NULL))").alias("p"))
    listed = bounded.union(by_rare.select("p.a", "p.b")).distinct()
    listed = listed.join(side.alias("x"), F.col("a") == F.col("x.cid")).join(side.alias("y"), F.col("b") == F.col("y.cid"))
    cross = cross.union(listed.where(_may_link("x", "y")).select("a", "b")).distinct()
    cross = saved(cross.join(stars, ["a", "b"], "left_anti"), "dedup-cross")
    more = saved(_confirmed(cross, classes, docs), "dedup-more-links")
    if more.isEmpty():
        final = joined
    else:
        final = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    final = saved(final, "dedup-final")

    named = classes.select("cid", "rep", "d1", "d2").join(final, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy(F.col("root").alias("__root")).agg(F.min("rep").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("__root")).select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "component_id")
    out = rows.join(named, (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "uid")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, one of each group, with all their columns whatever their names.

    Of rows equal in id and text one stays, whichever its other columns. Rows with a null, empty or wordless text
    are groups of their own. Of ids with several texts each text is judged by itself. Empty table: no rows.
    """
    result = near_duplicates(docs, id_col, text_col)
    kept = small(result.where("kept").select(F.col("uid").alias("__uid")).distinct(), "dedup-kept")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("own")).join(kept, F.col("own") == F.col("__uid"), "left_semi")
    repeated = saved(result.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("uid").alias("__uid")), "dedup-repeated")
    if repeated.isEmpty():
        return rows.select("row.*")
    again = rows.join(small(repeated, "dedup-again"), F.col("own") == F.col("__uid"), "left_semi").dropDuplicates(["own"])
    return rows.join(small(repeated, "dedup-once"), F.col("own") == F.col("__uid"), "left_anti").unionByName(again).select("row.*")
