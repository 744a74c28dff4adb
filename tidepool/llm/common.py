"""Small helpers the operators of this package share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import scratch_path

MASK = (1 << 64) - 1
#: odd 64-bit multipliers for mixing hashes
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: characters that end a word or are stripped from a line: space and \t to \r
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of the caller, whatever they are called, never meet
    the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: paths written within the running calls of :func:`settled`, innermost last
_open: list[list[str]] = []


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet under the shared ``spark.checkpoint.dir`` and read back: the
    lineage ends there, and any executor can read it again after another was lost."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame that ``make`` returns, stored; whatever else was stored while making it is deleted."""
    _open.append([])
    try:
        made = make()
        outer, mine = (_open[-2:-1] or [None])[0], _open[-1]
        path = scratch_path(made.sparkSession, f"{name}-{uuid.uuid4().hex}")
        made.write.parquet(path)
        if outer is not None:
            outer.append(path)
        for p in mine:
            _delete(made.sparkSession, p)
        return made.sparkSession.read.schema(made.schema).parquet(path)
    finally:
        _open.pop()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`stored`, once nothing reads it any more."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir").split(":", 1)[-1].rstrip("/")
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root.strip("/") in folder:
            _delete(df.sparkSession, folder)


def batch_rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def in_chunks(batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Run ``work`` over slices of at most ``rows`` rows, so that what a task holds beside its
    input batch stays small however many long texts the batch has."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            out = work(batch.slice(at, rows))
            if out is not None and out.num_rows:
                yield out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` consecutive word hashes, order-sensitive."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= MULT
        out += hashes[k:k + n]
    return mix(out)


def crc_fold(col, folds: int = 5):
    """crc32 of the id's decimal text, mod ``folds``: 0 marks a held-out document."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds))

