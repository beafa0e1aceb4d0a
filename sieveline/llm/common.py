"""Helpers that the operators of this package share: staged tables and Arrow text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import staging

#: Keys with more than 1 / HEAVY of the rows are handled apart; it bounds what is broadcast.
HEAVY = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode, else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(_remove_local, found)
    return found


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


#: Folders and tables that operators have written for later steps, until release().
_made: list[tuple[str, str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts lineage, and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sieveline-{name}-{uuid.uuid4().hex}"
    _made.append(("folder", path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes what the operators have staged so far; call it when their results have been written."""
    while _made:
        kind, name = _made.pop()
        if kind == "table":
            spark.sql(f"drop table if exists {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def note_table(name: str, path: str) -> None:
    _made.extend([("folder", path), ("table", name)])


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no model may learn labels from: crc32 of the id's decimal text leaves 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def spread(key: str, seed: int) -> Column:
    """A number from 0 to 2^63 - 1, even over the keys: the bits of a hash, its low 20 first."""
    h = F.expr(f"xxhash64(`{key}`, {seed})")
    return F.shiftleft(h.bitwiseAND(F.lit((1 << 20) - 1)), 43) + F.shiftrightunsigned(h, 20).bitwiseAND(F.lit((1 << 43) - 1))


def share_bound(part: float, whole: int) -> int:
    """The bound that `spread` is under or at for about part of whole rows."""
    return (1 << 63) - 1 if part >= whole else int(part * (1 << 63) / whole)


def one_of(key: str, values: list) -> Column:
    """Whether a column holds one of a few values (numbers, texts or bytes), written as one expression."""

    def text(v) -> str:
        return str(v) if isinstance(v, int) else f"X'{bytes(v).hex()}'" if isinstance(v, (bytes, bytearray)) else "decode(X'" + v.encode().hex() + "', 'utf-8')"

    return F.expr(f"`{key}` in ({', '.join(map(text, values))})") if values else F.lit(False)


def heavy_keys(right: DataFrame, key: str, n: str = "n", total: int | None = None) -> list:
    """The keys that stand for more than 1 / HEAVY of the rows; right: a row for each key, with its number of rows in column n. There are fewer than HEAVY."""
    total = (right.agg(F.sum(n)).head()[0] or 0) if total is None else total
    return [r[0] for r in right.where(F.col(n) > total / HEAVY).select(key).limit(HEAVY).collect()]  # the limit states the bound; it cuts nothing


def heavy_join(left: DataFrame, right: DataFrame, key: str, n: str = "n", keys: list | None = None) -> DataFrame:
    """left joined with right on a key of which a few values may hold most rows of left.

    right has one row for each key, and in column n how many rows of left have it; it should be a staged table. Keys with
    more than 1 / HEAVY of the rows, fewer than HEAVY (keys, if they are known already), are broadcast, and told by a filter, as a join would
    pass on every other row.
    """
    keys = heavy_keys(right, key, n) if keys is None else keys
    hot = one_of(key, keys)
    if not keys:
        return left.join(right, key)
    return left.where(hot).join(F.broadcast(right.where(hot)), key).unionByName(left.where(~hot).join(right.where(~hot), key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a folder; a table in fewer partitions than there are cores is spread over them."""
    return staging.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, UTF-8 bytes, offsets from 0) of runs of rows of about `limit` bytes.

    A null counts as empty. A text longer than the limit makes a chunk by itself; no text is cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def texts_of(column: pa.Array) -> list[str]:
    return column.cast(pa.large_string()).fill_null("").to_pylist()


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """batch with columns put at its end; one of the same name goes."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in names]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], names=[*(batch.schema.names[i] for i in keep), *names])


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned words; wraps on overflow."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
