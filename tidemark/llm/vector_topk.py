"""Exact top-k inner products by a pivot-distance index (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import in_python, saved

#: Pivots and rings (annuli) around each; both are chosen from SAMPLE vectors, the least by a hash of their ids.
PIVOTS, RINGS, SAMPLE = 64, 8, 4_096
#: Vectors in a block of the index, queries that are searched together, and vectors that bound a query's best k, about.
BLOCK, TOGETHER, SEEDS = 1_024, 256, 256
#: Shelves of blocks at least, and bytes of the vectors on one at most, about. Each query goes to a shelf once, so all requests take SHELVES times
#: the queries' bytes until a shelf would be too large.
SHELVES, SHELF_BYTES = 64, 32 << 20
#: A double in place of an exact distance is off by less than this part of the lengths.
SLACK = 1e-6
_LOWEST = -(1 << 63)


class Geometry:
    """Pivots, ring edges and the largest norm: how vectors are keyed and what distances are possible.

    With m2 the largest squared norm, a vector v becomes (v, sqrt(m2 - |v|^2)) and a query (q, 0); then
    |q - v|^2 = |q|^2 + m2 - 2 q.v, so the nearest vectors have the highest inner products.
    """

    def __init__(self, sample: np.ndarray, m2: float, dim: int):
        self.m2, self.dim = m2, dim
        points = self.lift(sample)
        chosen = [0]
        gap = self._distances(points, points[:1])[:, 0]
        while len(chosen) < min(PIVOTS, len(points)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, self._distances(points, points[chosen[-1:]])[:, 0])
        self.pivots = points[chosen]
        self.edges = np.quantile(self._distances(points, self.pivots).min(axis=1), np.arange(1, RINGS) / RINGS)
        self.cells: dict[int, tuple[int, float, float, int, int, int]] = {}  # rows, least and largest distance, blocks; rows and blocks of the cells before
        self.rows, self.shelves = 0, 1

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)))

    def shelve(self, cells: list[tuple[int, int, float, float]], width: int) -> None:
        """Sets the cells (cell, rows, least and largest distance, in order) of vectors of `width` bytes."""
        blocks = 0
        for cell, n, lo, hi in cells:
            self.cells[cell] = (n, lo, hi, -(-n // BLOCK), self.rows, blocks)
            self.rows, blocks = self.rows + n, blocks + self.cells[cell][3]
        self.shelves = max(SHELVES, -(-self.rows * width // SHELF_BYTES))

    def place(self, cell: int, salt: int) -> tuple[int, int]:
        """The block's number and its shelf; blocks stand in the order of cells, about as many rows on each shelf."""
        n, _, _, salts, rows, blocks = self.cells[cell]
        return blocks + salt, (rows + n * salt // salts) * self.shelves // self.rows

    def lift(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        v = vectors.astype(np.float64)
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.m2 - (v**2).sum(axis=1)))
        return np.column_stack([v, last])

    def key(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (nearest pivot and ring) and distance to the pivot of each vector."""
        d = self._distances(self.lift(vectors), self.pivots)
        pivot = d.argmin(axis=1)
        near = d[np.arange(len(d)), pivot]
        return pivot * RINGS + np.searchsorted(self.edges, near), near

    def to_pivots(self, queries: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return self._distances(self.lift(queries, query=True), self.pivots[pivots])

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and for each query and cell the least possible distance by the triangle inequality."""
        cells = np.array(sorted(self.cells), dtype=np.int64)
        d = self.to_pivots(queries, np.arange(len(self.pivots)))[:, cells // RINGS]
        lo, hi = (np.array([self.cells[c][i] for c in cells.tolist()]) for i in (1, 2))
        return cells, np.maximum(0, np.maximum(lo - d, d - hi))

    def reach(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """How far a vector may be to reach the floor: |q - v|^2 = |q|^2 + m2 - 2 q.v; infinite without a floor."""
        q2 = (queries.astype(np.float64) ** 2).sum(axis=1)
        far = np.sqrt(np.maximum(0, q2 + self.m2 - 2.0 * floors)) + SLACK * (np.sqrt(q2) + np.sqrt(self.m2) + 1)
        return np.where(floors == _LOWEST, np.inf, far)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), dtype=np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; as floats where no sum can leave their exact range."""
    top = vectors.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return queries.astype(kind) @ vectors.T.astype(kind)


def _keyed(geometry: Geometry, kind: str):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("ints"), geometry.dim)
            cells, near = geometry.key(vectors)
            arrays = [batch.column("uid"), batch.column("vec_id"), pa.array(cells.astype(np.int32)), pa.array(near), pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["uid", "vec_id", "cell", "near", "vec"])

    return keyed


def _pack(geometry: Geometry):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A block of the index: its vectors sorted by their distance to the pivot."""
        rows = rows.sort_values("near")
        block, shelf = geometry.place(int(key[0]), int(key[1]))
        numbers = {c: [rows[c].to_numpy(t).tobytes()] for c, t in (("uid", np.int64), ("vec_id", np.int64), ("near", np.float64))}
        return pd.DataFrame({"pivot": [int(key[0]) // RINGS], "block": [block], "shelf": [shelf], "uids": numbers["uid"], "ids": numbers["vec_id"], "nears": numbers["near"], "vecs": [b"".join(rows["vec"])]})

    return pack


def _requests(geometry: Geometry, kind: str, seeding: bool):
    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Where these queries must look: while seeding a block of each of the nearest annuli until SEEDS vectors are met, then all shelves with an annulus in reach."""
        queries = np.frombuffer(b"".join(rows["vec"]), dtype=kind).reshape(-1, geometry.dim)
        uids, floors = rows["uid"].to_numpy(np.int64), rows["floor"].to_numpy(np.int64)
        cells, least = geometry.bounds(queries)
        counts, salts = (np.array([geometry.cells[c][i] for c in cells.tolist()]) for i in (0, 3))
        if seeding:
            order = np.argsort(least, axis=1, kind="stable")
            met = np.cumsum((counts // salts)[order], axis=1) - (counts // salts)[order]
            wanted = np.zeros(least.shape, dtype=bool)
            np.put_along_axis(wanted, order, met <= SEEDS, axis=1)
            # Groups that want one cell take different blocks of it.
            asked = [(geometry.place(int(cells[j]), int(key[1]) % int(salts[j]))[0], wanted[:, j]) for j in range(len(cells))]
        else:
            wanted = least <= geometry.reach(queries, floors)[:, None]
            first, last = (np.array([geometry.place(c, n - 1)[1] for c, n in zip(cells.tolist(), ends, strict=True)]) for ends in ([1] * len(cells), salts.tolist()))
            asked = [(shelf, wanted[:, (first <= shelf) & (shelf <= last)].any(axis=1)) for shelf in range(geometry.shelves)]
        out = [(place, uids[who].tobytes(), queries[who].tobytes(), floors[who].tobytes()) for place, who in asked if who.any()]
        return pd.DataFrame(out, columns=["place", "q_uids", "q_vecs", "q_floors"])

    return ask


class _Best:
    """The best k of each query of a request over the blocks that it meets one after another; floors rise on the way."""

    def __init__(self, geometry: Geometry, kind: str, k: int, row: dict):
        self.geometry, self.kind, self.k, self.name = geometry, kind, k, (row["place"], row["q_uids"])
        self.uids, self.floors = (np.frombuffer(row[c], dtype=np.int64).copy() for c in ("q_uids", "q_floors"))
        self.queries = np.frombuffer(row["q_vecs"], dtype=kind).reshape(-1, geometry.dim)
        self.gaps = geometry.to_pivots(self.queries, np.arange(len(geometry.pivots)))
        self.found = [np.zeros(0, dtype=np.int64)] * 4  # the query's place, and its candidates' uid, vec_id and score

    def annulus(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each query the first vector of the block within its reach, and the end."""
        near, d, reach = np.frombuffer(row["nears"], dtype=np.float64), self.gaps[:, row["pivot"]], self.geometry.reach(self.queries, self.floors)
        return np.searchsorted(near, d - reach), np.searchsorted(near, d + reach, side="right")

    def meet(self, row: dict) -> None:
        lo, hi = self.annulus(row)
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return
        a, b = lo[open_].min(), hi[open_].max()
        uids, ids = (np.frombuffer(row[c], dtype=np.int64)[a:b] for c in ("uids", "ids"))
        scores = _products(self.queries[open_], np.frombuffer(row["vecs"], dtype=self.kind).reshape(-1, self.geometry.dim)[a:b])
        floors = self.floors[open_].astype(scores.dtype)
        good = scores >= floors[:, None]
        if b - a > self.k and np.count_nonzero(good) > 8 * self.k * len(open_):
            # Without the query itself the k-th best reaches what is the next of all.
            good = scores >= np.maximum(floors, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1])[:, None]
        i, j = np.nonzero(good)
        other = self.uids[open_[i]] != uids[j]
        i, j = i[other], j[other]
        self.found = [np.concatenate(x) for x in zip(self.found, (open_[i], uids[j], ids[j], scores[i, j].astype(np.int64)), strict=True)]
        if len(self.found[0]) > 2 * self.k * len(self.queries):
            self._cut()

    def _cut(self) -> None:
        who, uids, ids, scores = self.found
        order = np.lexsort((uids, ids, -scores, who))
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        self.found = [x[order[rank < self.k]] for x in self.found]
        last = order[rank == self.k - 1]
        self.floors[who[last]] = np.maximum(self.floors[who[last]], scores[last])

    def result(self) -> list[np.ndarray]:
        self._cut()
        return [self.uids[self.found[0]], *self.found[1:]]


def _look(geometry: Geometry, kind: str, k: int, measure: bool):
    """Each request's best k of the blocks that follow one another, of those that reach the floor; when measuring, the number of vectors within a query's reach instead."""

    def given(arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["query", "uid", "vec_id", "score"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for row in batch.to_pylist():
                if best is None or best.name != (row["place"], row["q_uids"]):
                    if best is not None and not measure:
                        yield given(best.result())
                    best = _Best(geometry, kind, k, row)
                if measure:
                    lo, hi = best.annulus(row)
                    yield given([best.uids, best.uids, best.uids, np.maximum(0, hi - lo)])
                else:
                    best.meet(row)
        if best is not None and not measure:
            yield given(best.result())

    return look


class Index:
    """The pivot-distance index of a table of vectors; what the driver holds is PIVOTS * RINGS cells' bounds and SAMPLE vectors at most."""

    def __init__(self, vectors: DataFrame, every: int, id_col: str, vector_col: str):
        x = F.col(vector_col)
        whole = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        ints = vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("ints"))
        ints = saved(ints.withColumn("uid", F.monotonically_increasing_id()), "vectors")  # written, so that a row's number is fixed
        norm = F.aggregate("ints", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
        size = ints.agg(F.max(F.size("ints")).alias("dim"), F.max(norm).alias("m2"), F.max(F.array_max(F.transform("ints", F.abs))).alias("top")).first()
        dim, m2 = max(1, int(size["dim"] or 1)), float(size["m2"] or 0)
        self.kind = next(t for t in ("int16", "int32", "int64") if int(size["top"] or 0) <= np.iinfo(t).max)
        sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id", "uid").limit(SAMPLE).toArrow()
        self.geometry = None
        if not len(sample):
            return
        self.geometry = Geometry(_matrix(sample.column("ints").combine_chunks(), dim), m2, dim)
        keyed = saved(in_python(ints, _keyed(self.geometry, self.kind), "uid long, vec_id long, cell int, near double, vec binary"), "vectors-keyed")
        asking = F.col("vec_id") % every == 0
        cells = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("lo"), F.max("near").alias("hi"), F.count_if(asking).alias("q")).orderBy("cell").collect()
        self.geometry.shelve([(r["cell"], r["n"], r["lo"], r["hi"]) for r in cells], dim * np.dtype(self.kind).itemsize)
        self.rows, self.queries_n = self.geometry.rows, sum(r["q"] for r in cells)

        def salted(df: DataFrame, pieces: dict[int, int]) -> DataFrame:
            of = F.element_at(F.create_map(*[F.lit(v) for pair in pieces.items() for v in pair]), F.col("cell"))
            return df.withColumn("salt", F.pmod(F.xxhash64("uid"), of).cast("int"))

        blocks = salted(keyed, {r["cell"]: -(-r["n"] // BLOCK) for r in cells}).groupBy("cell", "salt").applyInPandas(_pack(self.geometry), "pivot int, block int, shelf int, uids binary, ids binary, nears binary, vecs binary")
        self.blocks = saved(blocks, "vector-blocks")
        # Queries of neighbouring cells go together, about TOGETHER of them; a cell with more is cut by hash.
        together, group, held = {}, 0, 0
        for r in cells:
            group, held = (group + 1, 0) if held and held + r["q"] > TOGETHER else (group, held)
            together[r["cell"]], held = group, held + r["q"]
        of = F.element_at(F.create_map(*[F.lit(v) for pair in together.items() for v in pair]), F.col("cell"))
        self.queries = salted(keyed.where(asking), {r["cell"]: max(1, -(-r["q"] // TOGETHER)) for r in cells}).withColumn("cell", of)

    def search(self, asked: DataFrame, k: int, seeding: bool = False, measure: bool = False) -> DataFrame:
        """query, uid, vec_id, score: the best k of each query in each block (while seeding) or on each shelf that it looks at."""
        wanted = asked.groupBy("cell", "salt").applyInPandas(_requests(self.geometry, self.kind, seeding), "place int, q_uids binary, q_vecs binary, q_floors binary")
        # Spark takes the requests for as small as the queries and would broadcast them, through the driver.
        met = wanted.hint("merge").join(self.blocks, F.col("place") == F.col("block" if seeding else "shelf"))
        met = met.select("place", "q_uids", "q_vecs", "q_floors", "pivot", "uids", "ids", "nears", "vecs")
        return in_python(met, _look(self.geometry, self.kind, k, measure), "query long, uid long, vec_id long, score long")

    def bounded(self, k: int) -> DataFrame:
        """The queries, each with the score that its k-th best reaches at least, from the annuli nearest to it."""
        lowest = F.lit(_LOWEST).cast("long")
        first = ranked(self.search(self.queries.withColumn("floor", lowest), k, seeding=True), k).where(F.col("rank") == k)
        floors = saved(first.select(F.col("query").alias("__q"), F.col("score").alias("__floor")), "vector-floors")
        return self.queries.join(floors, F.col("uid") == F.col("__q"), "left").withColumn("floor", F.coalesce("__floor", lowest))


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all rows but its own.

    Components are floor(256 * x). Queries are the rows whose id is divisible by `every`. Ties go to the smaller id;
    fewer candidates give fewer rows. Null vectors, ids, components and non-finite components take no part. Shorter
    vectors, empty ones too, are filled up with zeros. Rows that repeat an id are queries and candidates each, of one
    another too. Empty table: no rows. Other columns are ignored.

    Each vector is keyed by its nearest pivot and the ring of its distance, and packed into blocks with others of its
    cell, sorted by distance. A first round looks at the nearest annuli until SEEDS vectors are met; their scores bound
    the distance that matters, and a second round visits just the blocks, and in them the annulus, in which the
    triangle inequality leaves room. Cells of any size are cut into blocks, and queries into groups, by hash. Blocks
    stand on shelves: a group of queries is sent to a shelf once, meets its blocks in turn and keeps its best k.
    """
    index = Index(vectors, every, id_col, vector_col)
    if index.geometry is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = ranked(index.search(index.bounded(k), k), k)
    names = index.queries.select(F.col("uid").alias("__uid"), F.col("vec_id").alias("query_id"))
    return found.join(names, F.col("query") == F.col("__uid")).select("query_id", "rank", "vec_id", "score")


def visited_share(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The part of all pairs of query and row that the triangle inequality leaves in the second round; 0 without queries."""
    index = Index(vectors, every, id_col, vector_col)
    if index.geometry is None or not index.queries_n:
        return 0.0
    seen = index.search(index.bounded(k), k, measure=True).agg(F.sum("score")).first()[0]
    return (seen or 0) / (index.queries_n * index.rows)
