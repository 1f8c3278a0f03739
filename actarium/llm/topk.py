"""Exact top-k search by inner product.

Queries and candidates are dealt into blocks of bounded size. Each pair of a query block and a candidate shard is one tile:
a matrix product, from which each query keeps its k best (partial selection); the lists of a query are then merged in a tree
over the shards. A tile holds at most `query_block` x `shard` vectors, whatever the size of the tables.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; neither do null ids and
vectors of another length than the query's. Rows that share an id count once (the least vector); components are cut to
+-2**40 so that every score fits a long. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_OUT = "query_id long, node long, vec_id long, score long"
_FAN = 8


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v, the integer vector floor(scale * x)."""
    x = F.col("embedding")
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = F.lit(float(1 << 40))
    v = F.transform(x, lambda c: F.greatest(-cut, F.least(cut, F.floor(c.cast("double") * scale).cast("double"))).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("v")).where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products, in the narrowest floating type that holds every partial sum."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best_of_tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, candidate id and score of each query's k best in the tile, its own id left out."""
    order = np.argsort(ids)
    ids, c = ids[order], c[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), rows):
        s = _scores(q[at:at + rows], c)
        own = ids[None, :] == query_ids[at:at + rows, None]
        low = np.int64(-(1 << 62))
        s[own] = low
        keep = min(k, s.shape[1])
        # score and place in one number, so that equal scores are taken by smaller id; else by a stable sort
        if np.abs(np.where(own, 0, s)).max(initial=0) < (1 << 62) // (s.shape[1] + 1):
            ranked = np.where(own, low, s * (s.shape[1] + 1) - np.arange(s.shape[1]))
            at_best = np.argpartition(-ranked, keep - 1, axis=1)[:, :keep]
        else:
            at_best = np.argsort(-s, axis=1, kind="stable")[:, :keep]
        query = np.repeat(query_ids[at:at + rows], keep)
        score = np.take_along_axis(s, at_best, axis=1).ravel()
        real = score != low
        out.append((query[real], ids[at_best].ravel()[real], score[real]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = 2048, shard: int = 16384, scale: int = 64) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best candidates of every query among all other vectors."""
    spark = vectors.sparkSession
    v = written(quantised(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))), "vectors")
    n, n_queries = v.agg(F.count("*"), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_queries // query_block))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    candidates = v.select(F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), spread.cast("int").alias("c_s")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c_b"))
    queries = v.where("is_query").select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"))
    queries = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))

    def tile(key, left, right):
        found = []
        if len(left) and len(right):
            size = right["c_v"].map(len).to_numpy()
            for d in sorted(set(left["v"].map(len))):
                a, b = left[left["v"].map(len) == d], right[size == d]
                if len(b):
                    query, vec, score = best_of_tile(a["vec_id"].to_numpy(), _matrix(a["v"]), b["c_id"].to_numpy(), _matrix(b["c_v"]), k)
                    found.append(pd.DataFrame({"query_id": query, "node": int(key[1]), "vec_id": vec, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "node", "vec_id", "score")})

    lists = queries.groupBy("b", "s").cogroup(candidates.groupBy("c_b", "c_s")).applyInPandas(tile, _OUT)
    nodes = shards
    while True:
        nodes = -(-nodes // _FAN)
        lists = lists.withColumn("node", F.floor(F.col("node") / _FAN))
        w = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
