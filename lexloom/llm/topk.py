"""Exact top-k inner-product search through a pivot-distance index (iDistance, Jagadish et al. 2005).

Vectors become integers floor(scale * x). With M2 the largest squared norm, x is lifted to (x, sqrt(M2 - |x|^2)) and a query to
(q, 0): squared distance is then |q|^2 + M2 - 2 <q, x>, so the nearest lifted vectors are those of the highest scores.

Index: pivots are k-means centres of a bounded sample (SAMPLE rows by hash); every row is keyed by its nearest pivot and its distance to
it, in rings around the pivot. A ring of more than CELL rows, such as one of very many equal vectors, is split by hash, so each
cell is of bounded size; the table of cells has a row a pivot and ring and a proven bound.

Search: queries stay distributed. Each starts from the k-th score within the sample, a true lower bound, and is dealt to a block of
at most about BLOCK queries of neighbouring pivots. A block meets a cell only if the bounds allow it: the triangle inequality on
the cell's ring, |d(q, p) - d(x, p)|, and on its pivot, (d(q, p) - d(q, nearest)) / 2, against the distance of the block's k-th
scores. Within a pair the cell's rows, sorted by distance to the pivot, are cut into annuli that are visited from the nearest
outward and scored only for queries whose k-th score so far leaves them in reach. Scores are exact integers.

How much that saves depends on the vectors. scored_share() tells it: for vectors that spread evenly in many dimensions nearly
every pair has to be scored, by this or any exact bound; in clustered data few are.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; vectors
shorter than the longest go on with zeros; a query never meets rows of its own id; ties go to the smaller id; fewer than k candidates give fewer rows; an empty table none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, stored

SCALE, PIVOTS, SAMPLE, ANNULUS = 256, 64, 4096, 1024
#: Rows of a cell and queries of a block, about; rings around a pivot at most.
CELL, BLOCK, RINGS = 1 << 16, 1 << 15, 64


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<double> of whole numbers) of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = table.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return sound.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no partial sum can pass 2**53, in Python integers beyond."""
    if float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return (queries.astype(object) @ rows.astype(object).T).astype(np.int64)


class _Space:
    """The lifted space: pivots and distances to them."""

    def __init__(self, sample: np.ndarray, top: float, pivots: int, rounds: int = 8):
        self.top = top
        lifted = self.lift(sample)
        chosen = [0] if len(lifted) else []
        near = np.full(len(lifted), np.inf)
        while chosen and len(chosen) < pivots:  # farthest first, from the sample's first row
            near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
            if not near.max() > 0:
                break
            chosen.append(int(near.argmax()))
        self.pivots = lifted[chosen]
        for _ in range(rounds):
            own = self.distances(lifted).argmin(axis=1)
            sums = np.zeros_like(self.pivots)
            np.add.at(sums, own, lifted)
            n = np.bincount(own, minlength=len(self.pivots))
            self.pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.pivots)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1, keepdims=True), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squared = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(squared, 0))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([x, np.zeros((len(x), 1))]))

    def reach(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Distance at which a score is still `least`, with room for rounding."""
        return np.sqrt(np.maximum((x * x).sum(axis=1) + self.top - 2 * least.astype(np.float64), 0)) * (1 + 1e-9) + 1e-6


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores a row, ties to smaller ids; ids and scores are matrices."""
    return np.lexsort((ids, -scores), axis=1)[:, :k]


_LOW = np.iinfo(np.int64).min + 1


def build_index(vectors: DataFrame, width: int, space: _Space) -> DataFrame:
    """vec_id, pivot, far and v of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.distances(space.lift(_matrix(batch.column(1), width)))
            pivot = d.argmin(axis=1)
            far = d[np.arange(len(d)), pivot]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pivot.astype(np.int32)), pa.array(far), batch.column(1)], ["vec_id", "pivot", "far", "v"])

    return stored(vectors.mapInArrow(run, "vec_id long, pivot int, far double, v array<double>"), "pivot-index")


def cells(index: DataFrame, n: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """index with cell, and cells(cell, c_pivot, near, far): a ring of a pivot, or a part of one by hash. At most pivots * RINGS rings."""
    rings = int(min(RINGS, max(1, n // (pivots * CELL))))
    edge = index.groupBy("pivot").agg(F.min("far").alias("r0"), F.max("far").alias("r1"))
    edge = F.broadcast(edge.select(F.col("pivot").alias("e_pivot"), "r0", F.greatest((F.col("r1") - F.col("r0")) / rings, F.lit(1e-9)).alias("step")))
    ringed = index.join(edge, F.col("pivot") == F.col("e_pivot"))
    ringed = ringed.withColumn("ring", F.least(F.floor((F.col("far") - F.col("r0")) / F.col("step")), F.lit(rings - 1)).cast("int")).select(*index.columns, "ring")
    found = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("away"))
    found = stored(found.select(F.col("pivot").alias("c_pivot"), F.col("ring").alias("c_ring"), F.ceil(F.col("n") / CELL).alias("parts"), "near", "away"), "cells")
    at = (F.col("pivot") == F.col("c_pivot")) & (F.col("ring") == F.col("c_ring"))
    name = lambda pivot, ring, part: F.concat_ws(":", pivot, ring, part)
    rows = ringed.join(F.broadcast(found.select("c_pivot", "c_ring", "parts")), at).select(*index.columns, name("pivot", "ring", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("cell"))
    table = found.select("c_pivot", "near", "away", F.col("c_ring"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return rows, table.select(name("c_pivot", "c_ring", "part").alias("cell"), "c_pivot", "near", "away")


def bounded_queries(wanted: DataFrame, width: int, space: _Space, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """query_id, q, q_pivot (the nearest) and least, a score that the k-th best is known to reach: the k-th within the sample."""
    sent = wanted.sparkSession.sparkContext.broadcast((sample_ids, sample))  # SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some_ids, some = sent.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            score = np.where(ids[:, None] == some_ids, _LOW, _scores(x, some))
            score = np.hstack([score, np.full((len(ids), k), _LOW)])
            least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            pivot = space.of_queries(x).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pivot), pa.array(least)], ["query_id", "q", "q_pivot", "least"])

    return stored(wanted.mapInArrow(run, "query_id long, q array<double>, q_pivot int, least long"), "bounded-queries")


def blocks(queries: DataFrame) -> DataFrame:
    """queries with block: neighbouring pivots share one, a pivot of over BLOCK queries is split by hash. One row a pivot reaches the driver."""
    counts = {r.q_pivot: r["count"] for r in queries.groupBy("q_pivot").count().collect()}
    rows, block, held = [], 0, 0
    for pivot in sorted(counts):
        parts = -(-counts[pivot] // BLOCK)
        if held and (parts > 1 or held + counts[pivot] > BLOCK):
            block, held = block + 1, 0
        rows.append((pivot, block, parts))
        held += counts[pivot]
        if parts > 1:
            block, held = block + parts, 0
    named = queries.sparkSession.createDataFrame(rows, "b_pivot int, first int, parts int")
    at = queries.join(F.broadcast(named), F.col("q_pivot") == F.col("b_pivot"))
    return at.select(*queries.columns, (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("parts"))).cast("int").alias("block"))


def pairs(queries: DataFrame, table: DataFrame, width: int, space: _Space) -> DataFrame:
    """(cell, block) that may hold a result, by the bounds of whole blocks against whole cells."""
    n = len(space.pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(3).to_numpy()
            x = _matrix(batch.column(1), width)
            d, reach = space.of_queries(x), space.reach(x, batch.column(2).to_numpy())
            for b in np.unique(block):
                own = d[block == b]
                reaches = reach[block == b]
                rival = ((own - own.min(axis=1, keepdims=True)) / 2 - reaches[:, None]).min(axis=0)
                cells = [pa.array(np.full(n, b, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0)), pa.array(np.full(n, reaches.max())), pa.array(rival)]
                yield pa.RecordBatch.from_arrays(cells, ["block", "pivot", "least", "most", "reach", "rival"])

    rows = queries.select("query_id", "q", "least", "block").mapInArrow(run, "block int, pivot int, least double, most double, reach double, rival double")
    sums = rows.groupBy("block", "pivot").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("reach").alias("reach"), F.min("rival").alias("rival"))
    gap = F.greatest(F.col("least") - F.col("away"), F.col("near") - F.col("most"))
    return sums.join(table, F.col("pivot") == F.col("c_pivot")).where((gap <= F.col("reach")) & (F.col("rival") <= 0)).select("cell", "block")


def search(rows: DataFrame, queries: DataFrame, meet: DataFrame, width: int, space: _Space, k: int) -> DataFrame:
    """Best k rows of each cell for each query of the blocks that meet it; and a row without query_id for each pair: how many
    vectors were scored (vec_id) of how many there are (score)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("far").combine_chunks()
        vec, far = left["vec_id"].to_numpy(), left["far"].to_numpy()
        x = _matrix(left["v"].combine_chunks(), width) if len(vec) else np.zeros((0, width))
        ids = right["query_id"].to_numpy()
        q = _matrix(right["q"].combine_chunks(), width) if len(ids) else np.zeros((0, width))
        bound, scored = right["least"].to_numpy().astype(np.float64), 0
        top_ids, top = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), _LOW)
        if len(vec) and len(ids):
            d = space.of_queries(q)
            pivot = left["pivot"][0].as_py()
            to_pivot, rival = d[:, pivot], (d[:, pivot] - d.min(axis=1)) / 2
            rings = [(a, min(a + ANNULUS, len(vec))) for a in range(0, len(vec), ANNULUS)]
            gaps = [np.maximum(rival, np.maximum(far[a] - to_pivot, to_pivot - far[b - 1])) for a, b in rings]
            for i in sorted(range(len(rings)), key=lambda i: gaps[i].mean()):
                a, b = rings[i]
                inside = np.flatnonzero(gaps[i] <= space.reach(q, bound))
                for part in np.array_split(inside, max(1, -(-len(inside) // 2048))):
                    if not len(part):
                        continue
                    scored += len(part) * (b - a)
                    near = np.where(ids[part][:, None] == vec[a:b], _LOW, _scores(q[part], x[a:b]))
                    hopeful = (near >= np.maximum(top[part, -1], np.floor(bound[part]))[:, None]).any(axis=1)
                    ask, near = part[hopeful], near[hopeful]
                    all_ids = np.hstack([top_ids[ask], np.broadcast_to(vec[a:b], near.shape)])
                    all_scores = np.hstack([top[ask], near])
                    best = _best(all_ids, all_scores, k)
                    top_ids[ask], top[ask] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_scores, best, 1)
                    bound[ask] = np.maximum(bound[ask], top[ask, -1])
        real = (top > _LOW) & (top >= right["least"].to_numpy()[:, None])
        cells = [np.broadcast_to(ids[:, None], top.shape)[real], top_ids[real], top[real]]
        found = pa.table([pa.array(c, pa.int64()) for c in cells], ["query_id", "vec_id", "score"])
        return pa.concat_tables([found, pa.table({"query_id": pa.array([None], pa.int64()), "vec_id": [scored], "score": [len(vec) * len(ids)]})])

    named = lambda side: meet.select(F.col("cell").alias(f"{side}_cell"), F.col("block").alias(f"{side}_block"))
    cells = rows.join(named("r"), F.col("cell") == F.col("r_cell")).groupBy("r_cell", "r_block")
    asked = queries.join(named("q"), F.col("block") == F.col("q_block")).groupBy("q_cell", "q_block")
    return cells.cogroup(asked).applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row for which is_query (a column) holds, its k best others."""
    parts = top_k_parts(table, is_query, k, pivots, id_col, vector, scale)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = parts.where("query_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def scored_share(parts: DataFrame, n_rows: int, n_queries: int) -> float:
    """Which share of all pairs of rows and queries was scored; parts: of top_k_parts()."""
    return (parts.where("query_id is null").agg(F.sum("vec_id")).head()[0] or 0) / max(n_rows * n_queries, 1)


def top_k_parts(table: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The best rows of every cell and block, written, with a row of statistics for each pair (see search())."""
    spark = table.sparkSession
    vectors = stored(integer_vectors(table, id_col, vector, scale), "vectors")
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).head()
    none = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if not facts.width:
        return none
    missing = F.array_repeat(F.lit(0.0), F.lit(facts.width) - F.size("v"))
    padded = vectors.withColumn("v", F.concat("v", missing))
    picked = padded.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    sample_ids, sample = picked.vec_id.to_numpy(), np.stack(picked.v.to_list())
    space = _Space(sample, facts.top, pivots)
    wanted = padded.where(is_query).select("vec_id", "v").distinct()
    queries = bounded_queries(wanted, facts.width, space, sample_ids, sample, k)
    if queries.isEmpty():
        return none
    index = build_index(padded, facts.width, space)
    rows, found = cells(index, facts.n, len(space.pivots))
    asked = stored(blocks(queries), "query-blocks")
    meet = stored(pairs(asked, found, facts.width, space), "cell-block-pairs")
    parts = stored(search(rows, asked, meet, facts.width, space, k), "topk-parts")
    for scratch in (vectors, queries, index, asked, meet):
        drop_stored(scratch)
    return parts


TOPK_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
