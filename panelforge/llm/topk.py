"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become integers, floor(1024 x). Candidates are sorted by length, longest first, and cut
into blocks of ``BLOCK`` rows; queries into blocks of ``QUERY_BLOCK``. A query visits only blocks
whose longest vector can still reach its threshold (|q| |c| >= t), and within a block only vectors
whose bound, the partial product over the leading rotated axes plus the product of the lengths of
the remainders, reaches it. The rotation comes from the second-moment matrix (dim x dim, summed by
partition). Thresholds start as the k-th best score against a seed block of the longest vectors, a
lower bound of the truth, and rise within each block. Survivors get exact integer products.

A (candidate block, query block) pair is one group of bounded size; blocks are ranges of (length,
id), so equal vectors, however many, are split like any others. Each pair yields at most k rows per
query, merged by rank.

Defined results: vectors that are null or hold null or non-finite components take no part, as
queries or as candidates, nor do rows with a null id. Shorter vectors count as padded with zeros, empty ones as zero. Ties go to
the smaller id. A query is a row: rows that share an id are queries of their own under that id, and
candidates of each other. An empty table gives an empty one. Only vec_id and the vector are read, so
other columns may have any name. Exact while |q| |c| < 2**53, which double arithmetic on integers
holds; beyond it products use Python integers, and a score beyond 64 bits raises OverflowError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_rank

SCALE = 1024
K = 10
BLOCK = 8192
QUERY_BLOCK = 1024
SEED_ROWS = 8192
#: Share of the axes in the first partial sum.
LEADING = 0.5
_EXACT = float(2**53)

OUT = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    x = F.col(vec)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    v = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("double"))
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim))
    for i, v in enumerate(col):
        out[i, : len(v)] = v
    return out


def rotation(c: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, by descending singular value."""

    def moments(frames):
        m = np.zeros((dim, dim))
        for f in frames:
            x = _matrix(f["v"], dim) / SCALE
            m += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(m)})

    sums = c.select("v").mapInPandas(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    g = np.zeros((dim, dim))
    for r in sums.collect():  # dim x dim numbers
        g[r[0], r[1]] = r[2]
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy()


def best(q: np.ndarray, qrow: np.ndarray, low: np.ndarray, c: np.ndarray, crow: np.ndarray, cid: np.ndarray, rot: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's place, vec_id, score) of up to k best candidates of each query with score >= low; c is
    in descending order of length. A row is no candidate of its own."""
    if not len(q) or not len(c):
        return []
    lead = max(1, int(rot.shape[1] * LEADING))
    qr, cr = q @ rot, c @ rot
    q1, c1 = qr[:, :lead], cr[:, :lead]
    q2, c2 = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((cr[:, lead:] ** 2).sum(1))
    qn, cn = np.sqrt((q**2).sum(1)), np.sqrt((c**2).sum(1))
    wide = qn.max() * cn.max() >= _EXACT
    slack = 1e-6 * (qn[:, None] * cn.max()) + 1e-3  # for rounding in the rotated sums
    rows, t = [], low.copy()
    kept: list[list[tuple[int, int]]] = [[] for _ in q]
    step = 1024
    for s in range(0, len(c), step):
        e = s + step
        near = np.flatnonzero(qn * cn[s] * (1 + 1e-9) + 1e-3 >= t)  # this step's longest vector
        if not len(near):
            continue
        bound = q1[near] @ c1[s:e].T + np.outer(q2[near], c2[s:e]) + slack[near]
        hit = (bound >= t[near, None]) & (qrow[near, None] != crow[None, s:e])
        for a, i in enumerate(near):
            j = np.flatnonzero(hit[a])
            if not len(j):
                continue
            if wide:
                score = [sum(int(x) * int(y) for x, y in zip(q[i], c[s + b], strict=True)) for b in j]
            else:
                score = (c[s:e][j] @ q[i]).astype(np.int64).tolist()
            got = kept[i] + [(-x, int(cid[s + b])) for x, b in zip(score, j, strict=True) if x >= t[i]]
            got.sort()
            kept[i] = got[:k]
            if len(kept[i]) == k:
                t[i] = max(t[i], -kept[i][-1][0])
    for i, got in enumerate(kept):
        if any(not -(2**63) <= -x < 2**63 for x, _ in got):
            raise OverflowError("a score is beyond 64 bits")
        rows += [(i, v, -x) for x, v in got]
    return rows


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors, queries: vec_id, v, norm as made by ``quantised``, and row, which tells rows apart in
    either table."""
    spark = vectors.sparkSession
    longest = [F.col("norm").desc(), F.col("vec_id"), F.col("row")]
    cands = with_rank(vectors, longest, "topk_vectors").withColumn("block", F.floor(F.col("rank") / block)).drop("rank")
    dim = cands.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    rot = rotation(cands, dim)
    seed = cands.orderBy(*longest).limit(SEED_ROWS).toPandas()  # a bounded block
    sc, srow = _matrix(seed["v"], dim), seed["row"].to_numpy()

    def thresholds(frames):
        for f in frames:
            x, low = _matrix(f["v"], dim), []
            for s in range(0, len(x), 256):
                part = x[s : s + 256] @ sc.T
                part[f["row"].to_numpy()[s : s + 256, None] == srow[None, :]] = -np.inf
                low.append(np.sort(part, axis=1)[:, -k] if part.shape[1] >= k else np.full(len(part), -np.inf))
            f = f.copy()
            # one part in 10**9 below: doubles are exact up to 2**53 only
            low = np.concatenate(low) if low else np.zeros(0)
            f["low"] = np.where(np.isfinite(low), low - np.abs(low) * 1e-9, -np.inf)
            yield f[["row", "vec_id", "v", "norm", "low"]]

    q = queries.select("row", "vec_id", "v", "norm").mapInPandas(thresholds, "row long, vec_id long, v array<double>, norm double, low double")
    q = with_rank(q, longest, "topk_queries").withColumn("qblock", F.floor(F.col("rank") / query_block)).drop("rank")
    cb = cands.groupBy("block").agg(F.max("norm").alias("most"))
    qb = q.groupBy("qblock").agg(F.max("norm").alias("qmost"), F.min("low").alias("qlow"))
    # block numbers only: one row per block on either side
    pairs = materialize(cb.join(qb, F.col("most") * F.col("qmost") * (1 + 1e-9) + 1e-3 >= F.col("qlow")).select("block", "qblock"), "topk_pairs")
    left = cands.join(pairs, "block").select("block", "qblock", "row", "vec_id", "v", "norm")
    right = q.join(pairs, "qblock").select("block", "qblock", "row", "vec_id", "v", "low")

    def search(c: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["norm", "vec_id"], ascending=[False, True], kind="stable")
        qrow, qid = x["row"].to_numpy(), x["vec_id"].to_numpy()
        rows = best(_matrix(x["v"], dim), qrow, x["low"].to_numpy(), _matrix(c["v"], dim), c["row"].to_numpy(), c["vec_id"].to_numpy(), rot, k)
        return pd.DataFrame([(qrow[i], qid[i], v, n) for i, v, n in rows], columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(search, OUT)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_query(vectors: DataFrame) -> DataFrame:
    v = materialize(quantised(vectors).filter("vec_id is not null").withColumn("row", F.monotonically_increasing_id()), "topk_rows")
    return top_k(v, v.filter(F.col("vec_id") % 100 == 0))


ORACLE = f"""
with e as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::hugeint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select q.rid as rid, q.vec_id as query_id, c.vec_id as vec_id,
    coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
  from (select * from e where vec_id % 100 = 0) q join e c on q.rid <> c.rid),
r as (select *, row_number() over (partition by rid order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
