"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Vectors are put on an integer grid, equal ones once. Their centred rows are dealt into numbered blocks of a distributed BlockMatrix; its
transpose times itself is the scatter matrix, a small square one, whose eigenvectors are found on the driver. The whitening matrix is multiplied in the
same way, and the products go back to the vectors by key. Blocks are written to the checkpoint folder as the matrix type's own
columns, so the JVM reads them without a Python object per row.
"""

from __future__ import annotations

import decimal
import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from seqlytics.operators.spread import split_join
from seqlytics.session import checkpoint, checkpoint_folder

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bytes of a block at most, and blocks that meet in one task of a product.
BLOCK_BYTES, BLOCKS_PER_TASK = 4 << 20, 16
#: A component whose eigenvalue is below this share of the largest is rounding error: vectors do not vary along it.
LEAST_SHARE = 1e-12
_INDEX = "struct<i:int,j:int>"
_MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


def _vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all vectors in double precision, where each begins, and whether it is free of nulls and finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().cast(pa.float64())
    bad = np.asarray(flat.is_null())
    values = np.asarray(flat.fill_null(0.0))
    first = np.cumsum(size) - size
    # beyond this a grid value is no 64-bit integer
    bad = bad | ~np.isfinite(values) | (np.abs(values) * SCALE > 2.0**62)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (wrong[first + size] == wrong[first]) & ~np.asarray(column.is_null()) & (size > 0)
    return values, np.stack([first, size], 1), good


def gridded(rows: DataFrame, vector: str = "embedding", carry: Sequence[str] = ("vec_id",)) -> DataFrame:
    """(carry..., key, size, x): ``x`` holds the grid values ``floor(64 c) + 1000000`` as bytes of 64-bit integers, ``key`` 128 bits of their hash.

    Null and empty vectors, and vectors with a null, a non-finite entry or one whose grid value is no 64-bit integer, are left out.
    """
    own = [c for c in carry]
    schema = StructType([f for c in own for f in rows.select(f"`{c}`").schema.fields]).add("key", "binary").add("size", "integer").add("x", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, place, good = _vectors(batch.column(len(own)))
            grid = np.floor(values * SCALE)
            grid[~np.isfinite(grid) | (np.abs(grid) > 2.0**62)] = 0
            raw = (grid.astype("<i8") + SHIFT).tobytes()
            x = [raw[8 * i : 8 * (i + n)] for i, n in place[good].tolist()]
            key = [hashlib.blake2b(v, digest_size=16).digest() for v in x]
            left = [c.filter(pa.array(good)) for c in batch.columns[: len(own)]]
            yield pa.RecordBatch.from_arrays([*left, pa.array(key, pa.binary()), pa.array(place[good, 1].astype(np.int32)), pa.array(x, pa.binary())], schema.names)

    picked = rows.select(*[f"`{c}`" for c in own], F.col(vector).alias("_vector_to_grid"))
    return picked.mapInArrow(run, schema)


def distinct_vectors(grid: DataFrame) -> DataFrame:
    """(key, x, size, piece): each grid vector of the commonest length once, ``piece`` the partition it was written in.

    Equal vectors meet in each task first, so one that fills the table costs a row per task. Of equally common lengths the longer one counts.
    """
    once = checkpoint(grid.select("key", "x", "size").distinct().withColumn("piece", F.spark_partition_id()))
    lengths = once.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return once.where(F.col("size") == (lengths[0].size if lengths else 0))


def sums_of(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), size)
            if np.abs(x).max(initial=0) * max(1, len(x)) >= 2.0**62:
                x = x.astype(object)
            total = [decimal.Decimal(int(v)) for v in x.sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total, pa.decimal128(38, 0)), pa.array(np.full(size, len(x)))], ["dim", "s", "n"])

    rows = fit.select("x").mapInArrow(run, "dim long, s decimal(38,0), n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums = [0] * size
    for r in rows:
        sums[r.dim] = int(r.s)
    return (rows[0].n if rows else 0), sums


def _matrix(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, size)


def _moved(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    """``n x - sums`` exactly; Python's integers where 64 bits may not hold it."""
    if max(np.abs(x).max(initial=0), 1) * float(n) >= 2.0**61 or max(map(abs, sums), default=0) >= 2**61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def centred_blocks(fit: DataFrame, n: int, sums: Sequence[int]) -> DataFrame:
    """(index, matrix, keys, deviation): numbered blocks of centred rows, with the keys and the exact deviations of their vectors.

    A block holds rows of one written partition, so that no row is shuffled; the last of each is shorter. Block numbers go on from piece to piece.
    """
    size = len(sums)
    most = max(1, BLOCK_BYTES // (8 * size))
    first, upto = {}, 0
    for piece, rows in sorted(fit.groupBy("piece").count().collect()):
        first[piece] = upto
        upto += -(-rows // most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, done, key, x = None, 0, [], []

        def block() -> pa.RecordBatch:
            moved = _moved(np.concatenate(x), n, sums)
            values = (moved / n).astype(np.float64)
            narrow = moved if moved.dtype != object and np.abs(moved).max(initial=0) < 2.0**31 / max(1, size) ** 0.5 else moved.astype(object)
            deviation = [str(v) for v in (narrow * narrow).sum(1).tolist()]
            index = {"i": first[piece] + done, "j": 0}
            matrix = {
                "type": 1, "numRows": len(values), "numCols": size, "colPtrs": None, "rowIndices": None,
                "values": values.ravel("F"), "isTransposed": False,
            }
            kinds = pa.schema([("index", pa.struct([("i", pa.int32()), ("j", pa.int32())])), ("matrix", _arrow_matrix()), ("keys", pa.list_(pa.binary())), ("deviation", pa.list_(pa.string()))])
            return pa.RecordBatch.from_pylist([{"index": index, "matrix": matrix, "keys": key, "deviation": deviation}], kinds)

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch.column(2)[0].as_py()
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - held)
                key += part.column(0).to_pylist()
                x.append(_matrix(part.column(1), size))
                held += part.num_rows
                at += part.num_rows
                if held == most:
                    yield block()
                    done, held, key, x = done + 1, 0, [], []
        if held:
            yield block()

    return fit.select("key", "x", "piece").mapInArrow(run, f"index {_INDEX}, matrix {_MATRIX}, keys array<binary>, deviation array<string>")


def _arrow_matrix() -> pa.DataType:
    ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    return pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", ints), ("rowIndices", ints), ("values", doubles), ("isTransposed", pa.bool_())])


def block_matrix(spark: SparkSession, path: str, rows: int, cols: int) -> BlockMatrix:
    """The BlockMatrix of written (index, matrix); blocks may hold fewer rows than ``rows``."""
    schema = StructType().add("index", StructType().add("i", "integer").add("j", "integer")).add("matrix", MatrixUDT())
    blocks = spark.read.schema(schema).parquet(path).select(F.struct(F.col("index.i").cast("long"), F.col("index.j").cast("long")), "matrix")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows, cols, 0, 0), rows, cols)


def scatter(a: BlockMatrix, tasks: int) -> np.ndarray:
    """The transpose of ``a`` times ``a``. Blocks meet in ``tasks`` tasks, which add theirs up before the sums meet."""
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of which vectors vary, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > max(LEAST_SHARE * max(e.max(initial=0.0), 0.0), 0.0)]
    e, v = e[order], v[:, order]
    lead = v[np.abs(v).argmax(0), np.arange(len(order))] if len(order) else np.ones(0)
    return e, v * np.where(lead < 0, -1.0, 1.0)


def _unpacked(product: DataFrame, k: int) -> DataFrame:
    """(key, deviation, whitened) of (values, keys, deviation): the rows of each block, whose values are column by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys = batch.column(1)[r].values
                values = np.asarray(batch.column(0)[r].values).reshape(k, len(keys)).T
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k, dtype=np.int32)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([keys, batch.column(2)[r].values, whitened], ["key", "deviation", "whitened"])

    return product.mapInArrow(run, "key binary, deviation string, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of (whitened) minus the identity: means first, then products of what is centred; a small table of sums each."""

    def summed(means: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k) if means is None else np.zeros((k, k))
            for batch in batches:
                w = np.asarray(batch.column(0).flatten()).reshape(-1, k)
                total += w.sum(0) if means is None else (w - means).T @ (w - means)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "s"])

        out = np.zeros(k if means is None else k * k)
        for r in whitened.select("whitened").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
            out[r["at"]] = r.s
        return out / n

    covariance = summed(summed(None)).reshape(k, k)
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(rows: DataFrame, vector: str = "embedding", carry: Sequence[str] = ("vec_id",), most: int = COMPONENTS) -> DataFrame:
    """(carry..., n, deviation, whitened, explained, identity_error): one row for each row of ``rows`` whose vector is whole.

    ``whitened`` and ``explained`` are arrays over the components, ``deviation`` is exact (decimal). Rows with equal vectors get equal results; ids may repeat
    or be null. Left out: what ``gridded`` leaves out, and vectors of another length than the commonest. Directions along which the vectors do not vary are
    no components, so one distinct vector has none. Columns of ``rows`` that are not in ``carry`` are not read. Empty table: no rows.
    """
    spark = rows.sparkSession
    grid = gridded(rows, vector, carry)
    own = [f"`{c}`" for c in carry]
    fit = distinct_vectors(grid)
    size = fit.agg(F.max("size")).first()[0]
    n, sums = sums_of(fit, size) if size else (0, [])
    path = f"{checkpoint_folder(spark)}/blocks-{uuid.uuid4().hex}"
    e = np.zeros(0)
    if n:
        centred_blocks(fit, n, sums).write.parquet(path)
        blocks = spark.read.parquet(path)
        count = blocks.count()
        a = block_matrix(spark, path, max(1, BLOCK_BYTES // (8 * size)), size)
        covariance = scatter(a, max(1, -(-count // BLOCKS_PER_TASK))) / n
        e, v = components(covariance, most)
    if not len(e):
        none = [F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")]
        none += [F.lit(None).cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error")]
        return grid.select(*own, *none).where("n is null")
    turn = v / np.sqrt(e)
    local = spark.sparkContext.parallelize([((0, 0), DenseMatrix(size, len(e), turn.ravel("F").tolist()))], 1)
    product = a.multiply(BlockMatrix(local, size, len(e)))
    done = f"{path}-product"
    callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("index", "matrix").write.parquet(done)
    raw = StructType().add("index", StructType().add("_1", "integer").add("_2", "integer")).add("matrix", StructType.fromDDL(_MATRIX[7:-1]))
    projected = spark.read.schema(raw).parquet(done).select(F.col("index._1").alias("i"), F.col("matrix.values").alias("values"))
    named = blocks.select(F.col("index.i").alias("i"), "keys", "deviation")
    table = checkpoint(_unpacked(projected.join(named, "i").select("values", "keys", "deviation"), len(e)))
    error = identity_error(table, n, len(e))
    out = split_join(grid.select(*own, "key"), table, ["key"])
    share = F.array(*[F.lit(float(x)) for x in e / np.trace(covariance)])
    return out.select(
        *own, F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )


def by_component(found: DataFrame, carry: Sequence[str] = ("vec_id",)) -> DataFrame:
    """The same with a row for each component, numbered from 1."""
    at: Column = F.col("_at")
    rows = found.select("*", F.posexplode("whitened").alias("_at", "_value"))
    return rows.select(
        *[f"`{c}`" for c in carry], (at + 1).cast("int").alias("component"), "n", "deviation", F.col("_value").alias("whitened"),
        F.get("explained", at).alias("explained"), "identity_error",
    )
