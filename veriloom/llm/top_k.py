"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Queries and vectors are dealt to a grid of (query block, candidate cell) tasks of bounded size. In a task, each component is
a term: its postings are the candidates that have a non-zero value there, and each query with a non-zero weight adds weight
times value to its dense array of scores. A partition selection keeps each query's best of the cell; a window over
(query, cell) winners merges them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sparse_columns(table, name: str):
    """Ids and, per component, the rows and values that aren't zero."""
    import numpy as np
    import pyarrow.compute as pc

    ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    lists = table.column(name).combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(ids) else np.zeros(0, np.int64)
    columns = []
    for d in range(int(lengths.max(initial=0))):
        rows = np.flatnonzero(lengths[order] > d)
        values = flat[starts[order][rows] + d]
        columns.append((rows[values != 0], values[values != 0]))
    return ids[order], columns


def _accumulate(queries, candidates, n_queries: int, n_candidates: int):
    """Scores of every query and candidate, term at a time; exact, and at the ends of a long where it would not hold them."""
    import numpy as np

    largest = sum(float(np.abs(w.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) for (_, w), (_, v) in zip(queries, candidates))
    exact = largest < 2**62
    scores = np.zeros((n_queries, n_candidates), np.int64 if exact else object)
    for (qs, weights), (cs, values) in zip(queries, candidates):
        if len(qs) and len(cs):
            add = np.multiply.outer(weights if exact else weights.astype(object), values if exact else values.astype(object))
            if len(cs) == n_candidates:
                scores[qs] += add
            else:
                scores[np.ix_(qs, cs)] += add
    return scores if exact else np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def _select(scores, query_id: int, ids, k: int):
    """Places of the k best of one row of scores, ties to the smaller id (ids ascend)."""
    import numpy as np

    other = np.flatnonzero(ids != query_id)
    s = scores[other]
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > edge)
        take = np.concatenate((above, np.flatnonzero(s == edge)[: k - len(above)]))
    else:
        take = np.arange(len(s))
    return other[take]


def _cell(k: int, query_step: int = 64):
    def run(candidates, queries):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if len(candidates) and len(queries):
            ids, columns = _sparse_columns(candidates, "parts")
            query_ids, query_columns = _sparse_columns(queries, "parts")
            for at in range(0, len(query_ids), query_step):
                n = min(query_step, len(query_ids) - at)
                block = []
                for rows, weights in query_columns:
                    a, b = np.searchsorted(rows, (at, at + n))
                    block.append((rows[a:b] - at, weights[a:b]))
                scores = _accumulate(block, columns, n, len(ids))
                for i in range(n):
                    best = _select(scores[i], query_ids[at + i], ids, k)
                    out[0].append(np.full(len(best), query_ids[at + i]))
                    out[1].append(ids[best])
                    out[2].append(scores[i][best])
        columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return run


def integer_parts(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, cell_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """Each query's k rows of highest integer inner product: query_id, rank (from 1), vec_id, score.

    `vectors` has vec_id and embedding; rows that meet `is_query` ask, all rows but those of the query's own id answer. Ties
    go to the smaller vec_id; queries with fewer candidates return all of them. Rows with a null id, a null vector or one
    that holds null or non-finite components take no part. Vectors may differ in length: what one lacks counts as zero, an
    empty vector scores 0. An id that repeats answers once per row and asks once, with the least of its vectors. Components
    and scores beyond a 64-bit integer stay at its ends. Other columns are left out, so their names can't clash.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), integer_parts(F.col("embedding"), scale).alias("parts"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("parts").alias("parts"))
    counted = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    cells, blocks = -(-counted["n"] // cell_rows) or 1, -(-counted["asked"] // query_rows) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "parts", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int").alias("cell"), each(blocks).alias("block"))
    queries = asked.select("vec_id", "parts", F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(blocks)).cast("int").alias("block"), each(cells).alias("cell"))
    found = candidates.groupBy("block", "cell").cogroup(queries.groupBy("block", "cell")).applyInArrow(_cell(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
