"""Operator 4: approximate nearest neighbours by inner product, over randomly rotated one-bit codes.

A vector less the mean of all is rotated at random and cut down to the signs of its components, packed to bits, with two numbers beside them:
its length, and how well the signs point its way. From these an inner product with a query is estimated without bias, within an error bound
that shrinks with the dimension. For each query and block of vectors, those whose upper bound reaches the twentieth best score known are
reranked by exact inner products in double precision.

Queries and vectors meet in blocks of bounded size: each block of queries with each block of codes. Each pair of blocks keeps the k best of
each query, which are then merged.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another length than the
query's are no candidates; rows with the query's own id are none either; equal rows are found as often as they occur; ties go to the smaller
id; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a block of candidates, and in a block of queries.
BLOCK, QUERY_BLOCK = 32_768, 1024
#: Standard errors of an estimate that the bound leaves room for.
MARGIN = 2.5
SCHEMA = "query_id long, vec_id long, score double"


def valid(v: str) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(v).isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same for the same dimension."""
    q, r = np.linalg.qr(np.random.default_rng([11, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors less the mean, their lengths, and the share of a unit vector that its signs catch."""
    y = (x - mean) @ rotation(x.shape[1])
    length = np.sqrt((y * y).sum(1))
    caught = np.divide(np.abs(y).sum(1) / np.sqrt(x.shape[1]), length, out=np.ones(len(x)), where=length > 0)
    return np.packbits(y > 0, axis=1), length, caught


def estimates(bits: np.ndarray, length: np.ndarray, caught: np.ndarray, mean: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries (rows) with coded vectors, and the error that they have at most (but for MARGIN's tail)."""
    dim = len(mean)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (query @ rotation(dim)).astype(np.float32)
    scale = (length / (caught * np.sqrt(dim))).astype(np.float32)
    about = (turned @ signs.T) * scale + (query @ mean)[:, None].astype(np.float32)
    spread = length * np.sqrt(np.maximum(0, 1 - caught**2)) / caught / np.sqrt(max(1, dim - 1))
    error = np.sqrt((query * query).sum(1))[:, None] * (MARGIN * spread + 1e-5 * (length + np.linalg.norm(mean)))[None, :]
    return about, error.astype(np.float32)


def best(ids: np.ndarray, x: np.ndarray, bits: np.ndarray, length: np.ndarray, caught: np.ndarray, mean: np.ndarray, query_ids: np.ndarray, query: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest in a block of vectors, for each query."""
    about, error = estimates(bits, length, caught, mean, query)
    out: tuple[list, list, list] = ([], [], [])
    for j in range(len(query)):
        other = ids != query_ids[j]
        upper = np.where(other, about[j] + error[j], -np.inf)
        first = np.argpartition(-np.where(other, about[j], -np.inf), min(2 * k, len(ids) - 1))[: 2 * k]
        first = first[other[first]]
        if not len(first):
            continue
        exact = x[first] @ query[j]
        least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
        # what is scored already stays, even where its own bound falls short
        near = np.union1d(first, np.flatnonzero(upper >= least))
        # one product a row, summed in the order of the components, so that equal vectors have equal scores
        score = (x[near] * query[j]).sum(1)
        order = np.lexsort((ids[near], -score))[:k]
        out[0].append(np.full(len(order), query_ids[j]))
        out[1].append(ids[near][order])
        out[2].append(score[order])
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _search(k: int, means: dict[int, list[float]]) -> Callable:
    def one(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not vectors.num_rows or not queries.num_rows:
            return empty
        dim = key[0].as_py()
        mean = np.array(means[dim])
        x, query = _matrix(vectors["v"], dim), _matrix(queries["v"], dim)
        bits = np.frombuffer(b"".join(vectors["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        found = best(vectors["vec_id"].to_numpy(), x, bits, vectors["length"].to_numpy(), vectors["caught"].to_numpy(), mean, queries["vec_id"].to_numpy(), query, k)
        return pa.table({n: pa.array(np.concatenate(c), t) for n, c, t in zip(empty.column_names, found, empty.schema.types, strict=True)}) if found[0] else empty

    return one


def _encode(means: dict[int, list[float]]) -> Callable:
    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = _matrix(pa.chunked_array([part.column(1)]), int(d))
                bits, length, caught = codes(x, np.array(means[int(d)]))
                yield pa.record_batch([*part.columns, pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(length), pa.array(caught)], [*part.schema.names, "code", "length", "caught"])

    return run


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v and dim of every valid vector."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return own.filter(valid("v") & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, list[float]]]:
    """vec_id, v, dim, code, length and caught of every valid vector; and the mean by dimension, from sums over all vectors."""
    own = taking_part(vectors, id_col, vector_col)
    sums = own.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("x"))
    means: dict[int, list[float]] = {}
    for r in sums.orderBy("dim", "at").collect():
        means.setdefault(r.dim, []).append(r.x)
    coded = own.mapInArrow(_encode(means), "vec_id long, v array<double>, dim int, code binary, length double, caught double")
    return coded, means


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest vectors of every vector whose row meets is_query (a condition on vec_id)."""
    coded, means = index(vectors, id_col, vector_col)
    queries = coded.filter(is_query).select("vec_id", "v", "dim")
    # counted before anything is encoded
    n, m = taking_part(vectors, id_col, vector_col).agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    # a pair of blocks is one task's work; there are at least as many as the session has shuffle partitions where vectors are many
    blocks = max(blocks, min(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 512))
    place = lambda c, many, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(many)).cast("int")
    # rows are spread by id and, as one id may repeat, by content
    left = coded.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id() % 64), F.lit(blocks)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("query_block", place("vec_id", query_blocks, "q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, means), SCHEMA)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
