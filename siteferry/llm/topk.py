"""Exact top-k search by inner product with vector-approximation files.

Each component of a vector is replaced by the number of its cell, one byte, between boundaries fitted on a bounded sample. The
approximations of all vectors are scanned for every query, block against block: the ends of the cells bound each
inner product from both sides, and vectors whose upper bound is below the k-th best lower bound are out. For the few
that are left the exact vectors are read, in the order of their upper bounds, until no later one can enter the result.
Bounds are exact integers, so nothing is missed; how well the cells fit changes only how many vectors are read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteferry.session import cut_lineage

K = 5
SCALE = 256
SAMPLE_VECTORS = 10_000
CELLS = 256
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 1_024

_BOUNDS = "query_id bigint, query_row bigint, vec_id bigint, row bigint, low double, high double"
_FOUND = "query_id bigint, rank int, vec_id bigint, score bigint"


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim and vector of floor(256 x), without vectors that are null, empty, or hold null or non-finite parts."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    whole = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("bigint"))
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.size(x).alias("dim"), whole.alias("vector"))


def fit_cells(vectors: DataFrame, sample: int = SAMPLE_VECTORS) -> dict[int, np.ndarray]:
    """For each dimension the ends of the cells of each component: CELLS + 1 rising integers, the last past the greatest value.

    The inner ends are quantiles of at most `sample` vectors, taken by a hash of the identifier; the outer ones come from
    all vectors, so every component of every vector lies in a cell.
    """
    parts = vectors.select("dim", F.posexplode("vector").alias("place", "value"))
    outer = parts.groupBy("dim", "place").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ends = {}
    for dim in {row["dim"] for row in outer}:
        own = np.array([row["vector"] for row in chosen if row["dim"] == dim], dtype=np.int64).reshape(-1, dim)
        grid = np.empty((dim, CELLS + 1), dtype=np.int64)
        for row in outer:
            if row["dim"] == dim:
                low, high, at = row["low"], row["high"], row["place"]
                inner = np.full(CELLS - 1, low)
                if len(own):
                    inner = np.quantile(own[:, at], np.arange(1, CELLS) / CELLS, method="nearest")
                grid[at] = np.concatenate(([low], np.clip(inner, low, high), [high + 1]))
        ends[dim] = grid
    return ends


def _coded(cells: dict[int, np.ndarray]):
    def code(vectors: pd.Series) -> pd.Series:
        out = []
        for vector in vectors:
            v = np.asarray(vector, dtype=np.int64)
            grid = cells[len(v)]
            # The last cell that begins at or below the value.
            out.append(((grid[:, 1:-1] <= v[:, None]).sum(axis=1)).astype(np.uint8).tobytes())
        return pd.Series(out)

    return F.pandas_udf(code, "binary")


def _bounder(cells: dict[int, np.ndarray], k: int):
    """Bounds of one block of approximations for one block of queries; rows that can be among the k best."""

    def bound(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or items.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "query_row", "vec_id", "row", "low", "high")})
        grid = cells[int(queries["dim"].iloc[0])]
        # Of equal vectors only those of the k + 1 smallest identifiers can count, one of which may be the query's own, and
        # of each identifier k rows.
        items = items.sort_values(["vec_id", "row"])
        items = items[items.groupby(["digest", "vec_id"]).cumcount() < k]
        items = items[items.groupby("digest")["vec_id"].rank(method="dense") <= k + 1]
        ids, rows = items["vec_id"].to_numpy(), items["row"].to_numpy()
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in items["codes"]]).astype(np.int64)
        places = np.arange(grid.shape[0])
        least = grid[places, codes].astype(np.float64)
        most = (grid[places, codes + 1] - 1).astype(np.float64)
        # A cell may be empty between equal ends; its values are then those of the end itself.
        most = np.maximum(most, least)
        asked = np.array(queries["vector"].tolist(), dtype=np.float64)
        plus, minus = np.maximum(asked, 0), np.minimum(asked, 0)
        low, high = plus @ least.T + minus @ most.T, plus @ most.T + minus @ least.T
        out = []
        for at, (query, query_row) in enumerate(zip(queries["vec_id"].to_numpy(), queries["row"].to_numpy())):
            other = ids != query
            lows = low[at][other]
            edge = np.partition(lows, len(lows) - k)[len(lows) - k] if len(lows) > k else -np.inf
            kept = np.flatnonzero(other & (high[at] >= edge))
            found = {"query_id": query, "query_row": query_row, "vec_id": ids[kept], "row": rows[kept]}
            out.append(pd.DataFrame(found | {"low": low[at][kept], "high": high[at][kept]}))
        return pd.concat(out)

    return bound


def _reader(k: int):
    """Exact results of some queries: candidates in the order of their upper bounds, until the k-th is certain."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for query, own in rows.groupby("query_id"):
            own = own.sort_values(["high", "vec_id"], ascending=[False, True])
            best: list[tuple[int, int]] = []  # (-score, vec_id)
            for high, vec_id, vector, asked in zip(own["high"], own["vec_id"], own["vector"], own["asked"]):
                if len(best) == k and high < -best[-1][0]:
                    break
                score = int(np.asarray(vector, dtype=np.int64) @ np.asarray(asked, dtype=np.int64))
                best = sorted([*best, (-score, vec_id)])[:k]
            found += [(query, rank, vec_id, -score) for rank, (score, vec_id) in enumerate(best, 1)]
        return pd.DataFrame(found, columns=["query_id", "rank", "vec_id", "score"])

    return read


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k greatest inner products of each query with the other rows: query_id, rank (from 1), vec_id, score.

    `is_query` is a condition on the identifier, as column vec_id. Ties go to the smaller vec_id. Vectors that are null or
    empty, or hold null or non-finite parts, and null identifiers take no part; vectors meet only those of their own
    length. Rows that repeat the query's identifier are its own and no candidates, and their vectors are asked for together:
    the best scores of any of them count. Other repeated identifiers count once for each row. A query with fewer than k others has them all, one without any has no row. An empty table gives no
    rows. Other columns are not read.
    """
    spark = embeddings.sparkSession
    # rows are told apart by number, since an identifier may stand on several
    vectors = cut_lineage(whole_vectors(embeddings, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    cells = fit_cells(vectors)
    if not cells:
        return spark.createDataFrame([], _FOUND)
    queries = vectors.filter(is_query)
    vector_blocks = -(-vectors.count() // block_vectors)
    query_blocks = max(1, -(-queries.count() // block_queries))
    digest = F.unhex(F.md5(F.array_join("vector", ",")))
    approximations = vectors.select("vec_id", "row", "dim", _coded(cells)("vector").alias("codes"), digest.alias("digest"))
    approximations = cut_lineage(approximations)
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "row", "dim", "vector", block(query_blocks).alias("qb")).select("*", every(vector_blocks).alias("vb"))
    right = approximations.select("*", block(vector_blocks).alias("vb")).select("*", every(query_blocks).alias("qb"))
    keys = ["dim", "qb", "vb"]
    bounds = cut_lineage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_bounder(cells, k), _BOUNDS))
    # The k-th best lower bound over all blocks rules out more than each block could.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("low").desc()))
    edges = bounds.withColumn("_rank", rank).filter(F.col("_rank") == k).select("query_id", F.col("low").alias("_edge"))
    kept = bounds.join(edges, "query_id", "left").filter("_edge is null or high >= _edge").select("query_id", "query_row", "vec_id", "row", "high")
    asked = queries.select(F.col("row").alias("query_row"), F.col("vector").alias("asked"))
    joined = kept.join(vectors.select("row", "vector"), "row").join(asked, "query_row").drop("row", "query_row")
    part = F.pmod(F.xxhash64("query_id"), F.lit(16 * query_blocks)).alias("_part")
    return joined.select("*", part).groupBy("_part").applyInPandas(_reader(k), _FOUND)


register_pickle_by_value(sys.modules[__name__])
