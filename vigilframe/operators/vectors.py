"""Vector retrieval: exact top-k, per-partition top-k, and re-ranking for diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


#: Queries that one block holds; so many are sent to the workers, more are met block by block.
QUERY_BLOCK = 4096
VECTOR_BLOCK = 65_536


def _best(ids: np.ndarray, matrix: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` vectors of a batch for each query; equal scores by key."""
    order = np.argsort(keys, kind="stable")
    keys, vectors = keys[order], vectors[order]
    found = []
    for at in range(0, len(ids), 512):
        scores = matrix[at : at + 512] @ vectors.T
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found.append((np.repeat(ids[at : at + 512], top.shape[1]), keys[top.ravel()], np.take_along_axis(scores, top, 1).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query", where: Column | None = None, part: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest vectors of each query by inner product, equal scores by id.

    With ``part``, a column of the vectors, the nearest of every part; the part is a column of the result.
    Null vectors and queries take no part.  ``where`` filters first, so that ``k`` hits remain.  Up to QUERY_BLOCK queries are sent to the workers, where every batch
    keeps its best ``k``.  More queries are cut into blocks, as are the vectors; every pair of blocks is a group of its
    own, so neither side is ever whole in one place.  The best of the kept rows are ranked.
    """
    base = vectors.filter(F.col(vector).isNotNull()) if where is None else vectors.filter(where & F.col(vector).isNotNull())
    queries = queries.filter(F.col(query_vector).isNotNull())
    q_type, v_type = queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    kept = [part] if part else []
    schema = f"`{query_id}` {q_type}, " + "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in kept) + f"`{id_col}` {v_type}, score double"
    names = [query_id, *kept, id_col, "score"]

    def best_of(ids: np.ndarray, matrix: np.ndarray, frame: pd.DataFrame, key: str, at: str) -> pd.DataFrame:
        found = []
        for value, own in frame.groupby(part, dropna=False, sort=False) if part else [(None, frame)]:
            one = dict(zip((query_id, id_col, "score"), _best(ids, matrix, own[key].to_numpy(), np.stack(own[at].to_numpy()).astype(np.float64), k)))
            if part:
                one[part] = [None if pd.isna(value) else value] * len(one["score"])
            found.append(pd.DataFrame(one)[names])
        return pd.concat(found)

    head = queries.select(query_id, query_vector).limit(QUERY_BLOCK + 1).collect()
    if len(head) <= QUERY_BLOCK:
        ids = np.array([r[0] for r in head])
        matrix = np.array([r[1] for r in head], np.float64) if head else np.zeros((0, 1))

        def batchwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(ids):
                    yield best_of(ids, matrix, batch, id_col, vector)

        found = base.select(*kept, id_col, vector).mapInPandas(batchwise, schema)
    else:
        blocks = int(np.ceil(queries.count() / QUERY_BLOCK))
        parts = max(1, int(np.ceil(base.count() / VECTOR_BLOCK)))
        part_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = queries.select(F.col(query_id).alias("_q"), F.col(query_vector).alias("_v"), part_of(query_id, blocks).alias("_a")).withColumn("_b", every(parts))
        right = base.select(*kept, F.col(id_col).alias("_i"), F.col(vector).alias("_v"), part_of(id_col, parts).alias("_b")).withColumn("_a", every(blocks))

        def pairwise(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({n: [] for n in names})
            return best_of(a["_q"].to_numpy(), np.stack(a["_v"].to_numpy()).astype(np.float64), b, "_i", "_v")

        found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(pairwise, schema)
    w = Window.partitionBy(query_id, *kept).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k_per(vectors: DataFrame, queries: DataFrame, k: int, part: str, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """The ``k`` nearest vectors of each query in every part."""
    return top_k(vectors, queries, k, id_col, vector, query_id, query_vector, part=part)


def mmr(vectors: DataFrame, queries: DataFrame, k: int, fetch: int = 20, balance: float = 0.5, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "query") -> DataFrame:
    """(query_id, id, rank): greedily the hit with the greatest balance x relevance - (1 - balance) x likeness to those taken.

    The pool is the top max(fetch, 2k) of each query, so a group is of that size; equal values go to the lesser id.
    """
    pool = top_k(vectors, queries, max(fetch, 2 * k), id_col, vector, query_id, query_vector)
    joined = pool.join(vectors.select(id_col, vector), id_col)
    q_type, v_type = queries.schema[query_id].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank"]).reset_index(drop=True)
        m = np.stack(group[vector].to_numpy()).astype(np.float64)
        relevance = group["score"].to_numpy()
        taken: list[int] = []
        most = np.full(len(group), -np.inf)
        while len(taken) < min(k, len(group)):
            value = balance * relevance - (1 - balance) * np.where(np.isinf(most), 0.0, most)
            value[taken] = -np.inf
            best = np.flatnonzero(value == value.max())
            pick = min(best, key=lambda i: group[id_col][i])
            taken.append(int(pick))
            most = np.maximum(most, m @ m[pick])
        return pd.DataFrame({query_id: group[query_id][0], id_col: group[id_col].to_numpy()[taken], "rank": np.arange(1, len(taken) + 1)})

    return joined.groupBy(query_id).applyInPandas(rerank, f"`{query_id}` {q_type}, `{id_col}` {v_type}, rank long")


def hashing_embedding(words: Column, size: int = 64) -> Column:
    """A deterministic embedding: signed counts of hashed words, of length one."""
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    signs = F.transform(words, lambda w: F.when(F.xxhash64(F.lit("sign"), w) % 2 == 0, 1.0).otherwise(-1.0))
    both = F.arrays_zip(slots.alias("s"), signs.alias("g"))
    counted = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(both, F.lit(0.0), lambda a, b: a + F.when(b["s"] == k, b["g"]).otherwise(0.0)))
    return l2_normalise(counted)
