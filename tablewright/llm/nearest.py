"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's offset from the centre is rotated at random and kept as one sign
bit per dimension with two scalars: its length, and the inner product of its
direction with its own code. From these the inner product with a query
is estimated together with an error bound; vectors whose lower bound on the
distance is above the k-th smallest upper bound of their block are passed
over, the others are reranked by the exact distance on the original vectors.

Rows are coded in blocks where they lie. Each block of queries meets each
block of codes once: query blocks are broadcast when a count shows them
small, else joined by block number. Only the best k of a block and query
travel on.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows without an id. Vectors are compared
with those of their own dimension. Equal vectors are ties, smaller id
first; a repeated id counts as often as it occurs, but never for its own query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.names import quote_ident

#: Rows that the centre is fitted on at most (a documented sample; every row is coded).
CENTRE_ROWS = 4_096
#: Width of the error bound: with one sign bit in 64 dimensions an estimate is
#: off by more than this many deviations about once in ten thousand.
WIDTH = 4.0
QUERIES_PER_BLOCK = 1_024
#: Query blocks up to this many bytes are broadcast.
BROADCAST_BYTES = 16 << 20


def usable(vector: Column) -> Column:
    """Not null, of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same for every worker."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of directions with their codes."""
    offset = vectors - centre
    length = np.sqrt((offset * offset).sum(1))
    turned = (offset / np.maximum(length, 1e-300)[:, None]) @ rotation(vectors.shape[1]).T
    own = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.maximum(own, 1e-9)


def bounds(queries: np.ndarray, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on the squared distances, queries by codes."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    offset = queries - centre
    far = np.sqrt((offset * offset).sum(1))
    turned = ((offset / np.maximum(far, 1e-300)[:, None]) @ rotation(dim).T).astype(np.float32)
    inner = (turned @ signs.T) / np.sqrt(dim) / own
    error = np.sqrt(np.maximum(1 / (own * own) - 1, 0)) * WIDTH / np.sqrt(max(dim - 1, 1)) + 1e-5
    square, cross = far[:, None] ** 2 + length**2, 2 * far[:, None] * length
    # an offset of zero has no direction: its distance is known
    error = np.where(length > 0, error, 0.0)
    return square - cross * np.minimum(inner + error, 1.0), square - cross * np.maximum(inner - error, -1.0)


def best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: tuple, centre: np.ndarray, k: int):
    """(query, id, distance) of the k nearest in one block of codes."""
    low, high = bounds(queries, centre, *codes)
    same = q_ids[:, None] == ids
    low[same], high[same] = np.inf, np.inf
    most = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q_ids), np.inf)
    out = []
    for i, q in enumerate(queries):
        at = np.flatnonzero((low[i] <= most[i] * (1 + 1e-6) + 1e-12) & ~same[i])
        gap = vectors[at] - q
        distance = np.sqrt((gap * gap).sum(1))
        first = np.lexsort((ids[at], distance))[:k]
        out.append((np.full(len(first), q_ids[i]), ids[at][first], distance[first]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def search(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row that ``is_query`` marks."""
    column = F.col(quote_ident(vector))
    rows = df.select(F.col(quote_ident(vec_id)).cast("long").alias("id"), column.alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    sample = rows.select("dim", "v").orderBy(F.xxhash64("id"), "id").limit(CENTRE_ROWS).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.v)
    centres = {d: np.mean(np.array(v, float), axis=0) for d, v in by_dim.items()}

    def centre(dim: int) -> np.ndarray:
        return centres.get(dim, np.zeros(dim))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = _matrix(part.column(1), dim)
                values = (part.column(0).to_numpy().astype(np.int64), vectors, *code(vectors, centre(dim)))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values)], names=["dim", "ids", "vectors", "bits", "length", "own"])

    coded = rows.select("id", "v", "dim").mapInArrow(blocks, "dim int, ids binary, vectors binary, bits binary, length binary, own binary")

    asked = rows.filter(F.col("q"))
    sizes = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per dimension
    n_blocks = {r.dim: -(-r.n // QUERIES_PER_BLOCK) for r in sizes}
    query_bytes = sum(r.n * (8 * r.dim + 8) for r in sizes)

    def gather(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        table = table.combine_chunks()
        vectors = _matrix(table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"], dim)
        ids = table["id"].to_numpy().astype(np.int64)
        return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "q_ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([vectors.tobytes()], pa.binary())})

    of_dim = F.create_map(*[F.lit(x) for d, n in n_blocks.items() for x in (d, n)]) if n_blocks else F.create_map(F.lit(0), F.lit(1))
    asked = asked.select("id", "v", "dim", F.pmod(F.xxhash64("id"), of_dim[F.col("dim")]).alias("block"))
    packed = asked.groupBy("dim", "block").applyInArrow(gather, "dim int, block long, q_ids binary, queries binary")
    if query_bytes <= BROADCAST_BYTES:
        packed = F.broadcast(packed)
    paired = coded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (of_dim[F.col("dim")] - 1).cast("long")))).join(packed, ["dim", "block"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, vectors, bits, length, own, q_ids, queries = (c[i].as_py() for c in batch.columns)
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                codes = np.frombuffer(bits, np.uint8).reshape(len(ids), -1), np.frombuffer(length), np.frombuffer(own)
                vectors, queries = np.frombuffer(vectors).reshape(-1, dim), np.frombuffer(queries).reshape(-1, dim)
                step = max(1, 4_000_000 // max(len(ids), 1))
                for at in range(0, len(q_ids), step):
                    found = best(q_ids[at : at + step], queries[at : at + step], ids, vectors, codes, centre(dim), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    near = paired.select("dim", "ids", "vectors", "bits", "length", "own", "q_ids", "queries").mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
