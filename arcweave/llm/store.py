"""Column helpers, maps that give memory back, and stored tables with this subpackage's codec."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arcweave.plans import tables
from arcweave.plans.tables import discard, fresh_path  # noqa: F401
from arcweave.plans.tables import partitions as shuffle_partitions  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """tables.stored, with texts in mind. What a lazy result still reads cannot be removed here; a cluster clears the
    folder as it clears checkpoints."""
    return tables.stored(df, name, codec)


class Scratch(tables.Scratch):
    def __init__(self):
        super().__init__("zstd")


def gives_back(mapped: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`mapped`, returning at the end of a task what its worker's allocators hold free to the system.

    Spark's workers serve one stage after another, so each would keep the size of its largest task beside the heap of
    its executor.
    """

    @wraps(mapped)
    def run(batches):
        yield from mapped(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, which codecs take well where the upper ones are 0."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(F.col(text) if isinstance(text, str) else text, UPPER, LOWER)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def by_place(columns: Sequence[str]) -> list[Column]:
    """These columns under names of their places, for mapInArrow, which resolves names and would trip over dots."""
    return [named(c).alias(f"c{i}") for i, c in enumerate(columns)]


def held_schema(docs: DataFrame, held: Sequence[str], new: str) -> StructType:
    """The schema of `held` columns of docs, then the DDL `new`."""
    return StructType([docs.schema[c] for c in held] + StructType.fromDDL(new).fields)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
