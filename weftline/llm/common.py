"""Shared plumbing of the training-data operators: scratch tables, checked broadcasts, native text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import scratch
from weftline.functions.scratch import scratch_path  # noqa: F401 - the operators take it from here

#: MB above which a side is never broadcast.
BROADCAST_MB = 24

#: Part of the driver's largest heap beyond which its garbage is collected between steps.
HEAP = 0.4

#: ASCII white space of the operator contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_clear: dict[str, Callable[[], None]] = {}
_owner = ""


def worker_cache(owner: str, clear: Callable[[], None]) -> None:
    """Name the function that empties what an operator remembers in a Python worker."""
    _clear[owner] = clear


def take_worker(owner: str) -> None:
    """Called by a task before it fills the caches of owner: what other operators left in this worker process goes."""
    global _owner
    if _owner == owner:
        return
    _owner = owner
    for name, clear in _clear.items():
        if name != owner:
            clear()
    rest_worker()


def rest_worker() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def rest_driver(spark: SparkSession) -> None:
    """Give back what the driver's JVM holds for nothing: its heap's garbage once the heap has grown (dead plans, and the
    shuffles and broadcasts that hang on them), and freed native memory.

    The collector by itself lets the heap grow to its limit, and the C library keeps what the compiler and the codecs
    freed; an operator of many steps fills both. A JVM that can't trim (before 17.0.9) goes without.
    """
    java = spark._jvm.java.lang
    if (now := java.Runtime.getRuntime()).totalMemory() > HEAP * now.maxMemory():
        gc.collect()  # what Python holds of the JVM's objects
        java.System.gc()
    with contextlib.suppress(Py4JJavaError):
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Ask the JVM's own command for it, by the method of the public interface: its class is not open to callers."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = array(jvm.java.lang.Object, 4)
    args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args[1] = "systemTrimNativeHeap"
    args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """scratch.materialize, and rest for the driver."""
    out = scratch.materialize(df, name)
    rest_driver(df.sparkSession)
    return out


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, with the worker's freed memory given back when the task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            rest_worker()

    return run


def _width(kind: T.DataType, c: Column) -> Column:
    """About the bytes that a value takes in a row, nested ones included."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return reduce(add, [_width(f.dataType, c[f.name]) for f in kind.fields], F.lit(8))
    if isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x: _width(kind.elementType, x).cast("long"))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")) + 24
    return F.lit(8)


def small(df: DataFrame, mb: int = BROADCAST_MB) -> DataFrame:
    """df with a broadcast hint if its rows take so many MB at most, else with a hint for a shuffled join.

    df is a table or a cheap step from one: its bytes are summed in a job of its own.
    """
    width = reduce(add, [_width(f.dataType, F.col(f.name)) for f in df.schema.fields], F.lit(16)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= mb << 20 else df.hint("merge")


def bounded_batches(spark: SparkSession, rows: int = 500, mb: int = 4) -> None:
    """Arrow batches of so many rows and MB at most (but a row), so that a run of long values fits in a Python worker."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def text_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the quick built-in serves strings that are all ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*cols: Column) -> list[Column]:
    """128 bits that identify a row by its content; equal rows share them."""
    return [F.xxhash64(*cols).alias("__k1"), F.xxhash64(F.lit(0x5EED), *reversed(cols)).alias("__k2")]
