"""Nearest documents by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.functions.ranking import newest_per_key

CHUNK = 1024


def _chunks(vectors: DataFrame, id_col: str, name: str) -> DataFrame:
    """Vectors gathered by about CHUNK to a row, as lists of ids and embeddings."""
    rows = vectors.where(F.col("embedding").isNotNull()).select(id_col, "embedding")
    parts = max(1, -(-rows.count() // CHUNK))
    return (
        rows.groupBy(F.pmod(F.xxhash64(id_col, "embedding"), F.lit(parts)).alias("part"))
        .agg(F.collect_list(F.struct(id_col, "embedding")).alias("v"))
        .select(F.col(f"v.{id_col}").alias(f"{name}_ids"), F.col("v.embedding").alias(f"{name}_vectors"))
    )


def _unit(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar corpus vectors of each query: (query_id, rank, vec_id, similarity).

    ``corpus``: (vec_id bigint, embedding); ``queries``: (query_id bigint, embedding), any
    number of them.  Exact: blocks of queries meet blocks of the corpus, one product of two
    matrices each; of a pair of blocks only k rows per query travel.  Similarities are rounded
    to six digits after ranking.  Ties go to the smaller vec_id; NULL vectors take no part.
    """

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sims = _unit(row.q_vectors) @ _unit(row.c_vectors).T
                found = np.broadcast_to(np.asarray(row.c_ids, np.int64), sims.shape)
                order = np.lexsort((found, -sims), axis=1)[:, :k]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(np.asarray(row.q_ids, np.int64), order.shape[1]),
                        "vec_id": np.take_along_axis(found, order, axis=1).ravel(),
                        "similarity": np.take_along_axis(sims, order, axis=1).ravel(),
                    }
                )

    # a stated list of queries against all rows, in blocks
    pairs = _chunks(corpus, "vec_id", "c").crossJoin(_chunks(queries, "query_id", "q"))
    partial = pairs.mapInPandas(nearest, "query_id bigint, vec_id bigint, similarity double")
    order = [F.col("similarity").desc(), F.col("vec_id").asc()]
    return newest_per_key(partial, ["query_id"], order, k, rank_col="rank").select(
        "query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity")
    )
