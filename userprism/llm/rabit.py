"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector of dimension d is scaled to length 1, rotated by a fixed random rotation and kept as
the signs of its components (d bits) with two scalars: its length, and ``align``, the inner
product of the rotated vector with its own sign vector over sqrt(d). The inner product of the
sign vector with a rotated query, over ``align``, estimates the inner product of the vectors
without bias; its error stays within ``sureness * sqrt(1 - align^2) / (align * sqrt(d - 1))``
but for a probability that falls fast with ``sureness``. In each block of codes the best
estimates are computed exactly first; their k-th score is a floor, and every vector whose
estimate plus error bound reaches the floor is computed exactly too. So nothing is capped.

Queries and rows meet in blocks of bounded size, each query gets k rows a block at most, and
these are ranked once more. Defined results: vectors that are null, zero, or hold a null or a
non-finite component take no part; neither do rows with a null id. Vectors meet only those of
their own dimension. Ties go to the smaller id; repeated rows count once each, a query's own
id is never its neighbour. Rows that repeat a query's id are one query, with the smallest of their
vectors. Extra columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.scale import stage

ROWS, QUERIES = 16384, 4096
SUREST = 2.4


def rotation(dimension, seed=7):
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def usable(vectors, id="vec_id", vector="embedding"):
    """(vec_id, vector, dimension) of the rows that take part, in double precision."""
    v = F.col(vector).cast("array<double>")
    return (
        vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .filter(F.exists("vector", lambda x: x != 0))
        .withColumn("dimension", F.size("vector"))
    )


def _matrix(column, dimension):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def encode(matrix):
    """(packed signs, length, align) of the rows of a matrix."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    turned = (matrix / length[:, None]) @ rotation(matrix.shape[1])
    align = np.abs(turned).sum(axis=1) / np.sqrt(matrix.shape[1])
    return np.packbits(turned >= 0, axis=1), length, align


def index(vectors, rows=ROWS):
    """The written index: every vector with its block, code and correction scalars."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dimension").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                codes, length, align = encode(_matrix(part.column("vector"), d))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("vec_id", "dimension", "block", "vector")),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(align)],
                    names=["vec_id", "dimension", "block", "vector", "code", "length", "align"],
                )

    good = usable(vectors)
    blocks = max(1, -(-good.count() // rows))
    placed = good.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return stage(placed.mapInArrow(
        run, "vec_id long, dimension int, block int, vector array<double>, code binary, length double, align double"
    )), blocks


def _nearest(codes, queries, k, sureness):
    """The k best rows of one block for each query: (query, row, score) with exact scores."""
    d = codes.column("dimension")[0].as_py()
    ids, own = codes.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
    rows, asked = _matrix(codes.column("vector"), d), _matrix(queries.column("vector"), d)
    bits = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    length, align = codes.column("length").to_numpy(), codes.column("align").to_numpy()
    scale = length / (align * np.sqrt(d))
    wide = sureness * length * np.sqrt(np.maximum(0, 1 - align * align)) / (align * np.sqrt(max(1, d - 1)))
    turned = (asked @ rotation(d)).astype(np.float32)
    size = np.sqrt((asked * asked).sum(axis=1))
    out = [], [], []
    for at in range(0, len(own), 256):
        estimates = (turned[at : at + 256] @ signs.T) * scale
        for n, estimate in enumerate(estimates, at):
            estimate[ids == own[n]] = -np.inf
            others = int((ids != own[n]).sum())
            if not others:
                continue
            take = min(k, others)
            first = np.argpartition(-estimate, take - 1)[:take]
            floor = (rows[first] * asked[n]).sum(axis=1).min()
            near = np.flatnonzero(estimate + wide * size[n] >= floor)
            near = np.union1d(near, first)
            exact = (rows[near] * asked[n]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:take]
            out[0].append(np.full(take, own[n]))
            out[1].append(ids[near][best])
            out[2].append(exact[best])
    flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
    return pa.table({
        "query_id": pa.array(flat[0], pa.int64()), "vec_id": pa.array(flat[1], pa.int64()), "score": pa.array(flat[2], pa.float64()),
    })


NEAREST = "query_id long, vec_id long, score double"


def search(indexed, blocks, queries, k=20, sureness=SUREST, per_block=QUERIES):
    """(query_id, rank, vec_id, score) of the k nearest rows of each query; ``queries`` as from ``usable``."""
    queries = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    queries = queries.withColumn("dimension", F.size("vector"))
    groups = max(1, -(-queries.count() // per_block))
    left = indexed.withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("asking", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def meet(codes, asked):
        return _nearest(codes, asked, k, sureness) if codes.num_rows and asked.num_rows else empty

    key = ["dimension", "block", "asking"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, NEAREST)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(vectors, every=20, k=20):
    """Neighbours of the rows whose id is divisible by ``every``, against all rows."""
    indexed, blocks = index(vectors)
    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "vector", "dimension")
    return search(indexed, blocks, queries, k)
