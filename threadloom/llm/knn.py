"""Exact top-k inner products by a Voronoi join.

1. *Pivots.* A bounded sample of vectors, chosen by a hash of their values. Every vector goes to the cell of its
   nearest pivot, with its distance to it.
2. *Summaries.* For each cell the number of vectors, the largest distance, and its ``k`` smallest distances. Cells are
   bounded in number, so summaries are small whatever the table.
3. *Bounds.* For a query q and a vector x of the cell of p at distance d, ``q.x = q.p + q.(x - p)`` lies within
   ``q.p ± |q| d``. The k-th largest lower bound over all summaries, after as many more as rows have the query's id, is a floor that the answer reaches, and a cell whose
   upper bound stays below it holds no answer. Only the other cells receive the query.
4. *Local answers.* Cells larger than ``PER_GROUP`` are dealt to salts, with their queries repeated. Each group is one
   matrix product in blocks; the groups' best ``k`` are merged for each query.

Components are turned into ``floor(1024 x)`` first, so scores are integers, exact in float64.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take no
part; vectors of another length than the query's are no candidates of it; ties go to the smaller id; repeated rows are
candidates as often as they stand there, and once for each row of the query, as in the SQL, except that no candidate has the query's own id; fewer candidates than ``k``
give all of them; without queries there is no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import release

PIVOTS = 256
PER_GROUP = 20_000
SCALE = 1024


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable rows as (id, dim, v): ``floor(1024 x)`` of each component, packed as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = np.floor(np.asarray(lists.flatten().cast(pa.float64())) * SCALE) if len(lists) else np.zeros(0)
            offs = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            raw = flat.astype(np.float64).tobytes()
            yield pa.record_batch({"id": batch.column(0), "dim": pa.array(np.diff(offs), pa.int32()), "v": pa.array([raw[8 * a : 8 * b] for a, b in zip(offs[:-1], offs[1:])], pa.binary())})

    v = F.col(vector_col)
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    usable = usable.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return usable.mapInArrow(run, "id long, dim int, v binary")


def _assign(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x, p = _matrix(part.column(2), dim), pivots[int(dim)]
                gap = (x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1)
                cell = gap.argmin(axis=1)
                dist = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                yield pa.record_batch({"id": part.column(0), "dim": part.column(1), "v": part.column(2), "cell": pa.array(cell, pa.int32()), "dist": pa.array(dist)})

    return run


def _route(pivots: dict[int, np.ndarray], cells: dict[int, dict[str, np.ndarray]], k: int):
    """Queries with each (cell, salt) that may hold one of their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                q, p, known = _matrix(part.column(2), dim), pivots[int(dim)], cells[int(dim)]
                norm = np.sqrt((q * q).sum(axis=1))[:, None]
                centre = q @ p.T
                # Rows of the query's id may be among the nearest and are no answers.
                low = (centre[:, :, None] - norm[:, :, None] * known["near"]).reshape(len(q), -1)
                at = k - 1 + part.column(3).to_numpy()
                floor = np.where(at < low.shape[1], -np.sort(-low, axis=1)[np.arange(len(q)), np.minimum(at, low.shape[1] - 1)], -np.inf)
                slack = 1e-9 * (1 + np.abs(centre) + norm * known["far"])
                rows, at = np.nonzero((centre + norm * known["far"] + slack >= np.where(np.isfinite(floor), floor, -np.inf)[:, None]) & (known["n"] > 0))
                salts = known["salts"][at]
                rows, cell = np.repeat(rows, salts), np.repeat(at, salts)
                salt = np.arange(len(rows)) - np.repeat(np.cumsum(salts) - salts, salts)
                got = part.take(pa.array(rows))
                yield pa.record_batch({"id": got.column(0), "dim": got.column(1), "v": got.column(2), "cell": pa.array(cell, pa.int32()), "salt": pa.array(salt, pa.int32())})

    return run


def _local(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        ids, out = data.column("id").to_numpy(), []
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            x = _matrix(data.column("v").combine_chunks(), dim)
            q_ids, q = queries.column("id").to_numpy(), _matrix(queries.column("v").combine_chunks(), dim)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            block = max(1, 4_000_000 // len(ids))
            for i in range(0, len(q), block):
                scores = q[i : i + block] @ x.T
                scores[q_ids[i : i + block, None] == ids] = -np.inf
                m = min(k, scores.shape[1])
                # Everything at or above the m-th score, so that ties are settled by id.
                least = -np.partition(-scores, m - 1, axis=1)[:, m - 1 : m]
                row, at = np.nonzero((scores >= least) & np.isfinite(scores))
                order = np.lexsort((ids[at], -scores[row, at], row))
                row, at = row[order], at[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, at = row[place < k], at[place < k]
                out.append((q_ids[i + row], ids[at], scores[row, at].astype(np.int64)))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(parts[0]), "vec_id": pa.array(parts[1]), "score": pa.array(parts[2])})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` highest scores of each query row against all other rows: query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    usable = cut_lineage(integer_vectors(vectors, id_col, vector_col))
    by_dim = Window.partitionBy("dim")
    # The first distinct vectors by hash; each length of vector gets its own.
    sample = usable.groupBy("dim", F.xxhash64("v").alias("key")).agg(F.min("v").alias("v")).orderBy("key").limit(4 * pivots).withColumn("n", F.row_number().over(by_dim.orderBy("key"))).where(F.col("n") <= pivots).collect()
    lengths = [x[0] for x in usable.select("dim").distinct().collect()]
    chosen = {d: np.array([np.frombuffer(r["v"], np.float64) for r in sample if r["dim"] == d]) for d in lengths}
    chosen = {d: p if len(p) else np.zeros((1, d)) for d, p in chosen.items()}
    placed = cut_lineage(usable.mapInArrow(_assign(chosen), "id long, dim int, v binary, cell int, dist double"))
    # The k + 1 smallest distances by counting in steps of growing width would lose exactness; ranks inside salted cells do not.
    salted = placed.select("dim", "cell", "dist", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    inside = Window.partitionBy("dim", "cell", "part").orderBy("dist")
    near = salted.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= k + 1).groupBy("dim", "cell").agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k + 1).alias("near"))
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
    cells = {d: {"n": np.zeros(len(p), np.int64), "far": np.zeros(len(p)), "salts": np.ones(len(p), np.int64), "near": np.full((len(p), k + 1), np.inf)} for d, p in chosen.items()}
    for dim, cell, n, far, close in sizes.join(near, ["dim", "cell"]).collect():
        own = cells[dim]
        own["n"][cell], own["far"][cell], own["salts"][cell] = n, far, -(-n // PER_GROUP)
        own["near"][cell, : len(close)] = close
    salts = spark.createDataFrame([(d, i, int(s)) for d, own in cells.items() for i, s in enumerate(own["salts"])] or [(0, 0, 1)], "dim int, cell int, salts int")
    data = placed.join(F.broadcast(salts), ["dim", "cell"]).select("id", "dim", "v", "cell", F.pmod(F.xxhash64("id", "v"), F.col("salts")).cast("int").alias("salt"))
    repeated = usable.groupBy("id", "dim").agg(F.count(F.lit(1)).alias("own")).where("own > 1")
    queries = usable.where(is_query).join(repeated, ["id", "dim"], "left").select("id", "dim", "v", F.coalesce("own", F.lit(1)).alias("own"))
    asked = queries.mapInArrow(_route(chosen, cells, k), "id long, dim int, v binary, cell int, salt int")
    keys = ("dim", "cell", "salt")
    local = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_local(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    release(spark)
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
