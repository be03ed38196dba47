"""Exact deduplication by composable polynomial fingerprints.

A fingerprint is the byte string read as a number in four bases, modulo four primes, with its length. Fingerprints of
neighbouring chunks combine by length-shifted arithmetic, ``H(a+b) = H(a) * B**len(b) + H(b)``, so huge texts are cut
into chunk rows that are hashed in parallel and folded. Rows of equal fingerprint are then compared with the row that
stays, chunk by chunk, in streams sorted by fingerprint; groups that hold different texts are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import materialize, small, text_of, tidy

#: Primes just below 2**31, and bases drawn once.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 742938285, 1566083941, 950706376)
CHUNK = 1 << 16
#: Code points above which a text is hashed as several rows.
HUGE = 1 << 20
#: Members of a group that one stream compares.
STREAM = 256

_FP = T.StructType([T.StructField(c, T.LongType()) for c in ("fp1", "fp2", "nbytes")])

_powers: np.ndarray | None = None


def _power_table() -> np.ndarray:
    """Row i holds each base to the power CHUNK - 1 - i."""
    global _powers
    if _powers is None:
        table = np.ones((CHUNK, len(PRIMES)), dtype=np.int64)
        for j, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
            x = 1
            for i in range(CHUNK - 1, -1, -1):
                table[i, j] = x
                x = x * base % prime
        _powers = table
    return _powers


def combine(left: tuple[tuple[int, ...], int], right: tuple[tuple[int, ...], int]) -> tuple[tuple[int, ...], int]:
    """The fingerprint of two byte strings in a row from those of each."""
    (a, n), (b, m) = left, right
    return tuple((x * pow(base, m, prime) + y) % prime for x, y, base, prime in zip(a, b, BASES, PRIMES, strict=True)), n + m


def fingerprint(data: bytes) -> tuple[tuple[int, ...], int]:
    """Residues and length; bytes count from 1, so zero bytes in front matter."""
    table, total = _power_table(), ((0,) * len(PRIMES), 0)
    for i in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - i), i).astype(np.int64) + 1
        sums = part @ table[CHUNK - len(part) :]
        total = combine(total, (tuple(int(s) % p for s, p in zip(sums, PRIMES, strict=True)), len(part)))
    return total


def _packed(f: tuple[tuple[int, ...], int]) -> tuple[int, int, int]:
    (a, b, c, d), n = f
    return a << 32 | b, c << 32 | d, n


@F.pandas_udf(_FP)
def _fingerprints(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_packed(fingerprint(t.encode())) for t in text], columns=["fp1", "fp2", "nbytes"], dtype="int64")


@F.pandas_udf(_FP)
def _folded(parts: pd.Series) -> pd.DataFrame:
    rows = []
    for chunks in parts:
        total = ((0,) * len(PRIMES), 0)
        for x in chunks:
            f = x["fp"]
            total = combine(total, ((f["fp1"] >> 32, f["fp1"] & 0xFFFFFFFF, f["fp2"] >> 32, f["fp2"] & 0xFFFFFFFF), f["nbytes"]))
        rows.append(_packed(total))
    return pd.DataFrame(rows, columns=["fp1", "fp2", "nbytes"], dtype="int64")


def _same(a: bytes, b: bytes) -> bool:
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(x), CHUNK))


def _differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprints under which texts differ; rows come sorted, the reference of each stream first."""
    key, reference = None, b""
    for pdf in batches:
        odd = []
        for row in pdf.itertuples(index=False):
            data = row.text.encode()
            if (now := (row.fp1, row.fp2, row.nbytes, row.salt)) != key:
                key, reference = now, data
            elif not _same(reference, data):
                odd.append(now[:3])
        yield pd.DataFrame(odd, columns=["fp1", "fp2", "nbytes"], dtype="int64")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", huge: int = HUGE, stream: int = STREAM) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest id stays;
    null ids lose to any other, and of several equal rows that share the largest id exactly one is kept. If all ids of a
    group are null, keep_id is null and one row is kept. An empty table gives an empty table; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).withColumn("__sha", F.sha2("__text", 256))
    ordinary = base.where(F.length("__text") <= huge).select("__id", "__sha", _fingerprints("__text").alias("__fp"))
    cut = base.where(F.length("__text") > huge).select("__sha", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("__text") - 1) / huge)), lambda i: F.substring("__text", (i * huge + 1).cast("int"), F.lit(huge)))).alias("__i", "__part"))
    # chunk rows are dealt out by text and position; copies of a text agree on both
    hashed = cut.repartition(F.col("__sha"), F.col("__i")).dropDuplicates(["__sha", "__i"]).select("__sha", "__i", _fingerprints("__part").alias("__fp"))
    folded = hashed.groupBy("__sha").agg(F.sort_array(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__fp").alias("fp")))).alias("__parts")).select("__sha", _folded("__parts").alias("__fp"))
    vast = base.where(F.length("__text") > huge).select("__id", "__sha").join(folded, "__sha").select("__id", "__sha", "__fp")
    counted = ordinary.unionByName(vast).groupBy("__id", "__sha", "__fp").agg(F.count(F.lit(1)).alias("__c"))
    rows = materialize(counted.select("__id", "__sha", "__fp.fp1", "__fp.fp2", "__fp.nbytes", "__c"), "fingerprints")

    fp = ["fp1", "fp2", "nbytes"]
    groups = materialize(rows.groupBy(*fp).agg(F.max("__id").alias("keep_id"), F.sum("__c").alias("group_size")).where("group_size > 1"), "equal-fingerprints")
    held = small(groups)

    members = materialize(rows.join(held, fp).select("__id", *fp, "keep_id", "group_size").distinct(), "members")
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text"))
    pairs = texts.join(small(members).withColumnRenamed("__id", "__m"), F.col("__id").eqNullSafe(F.col("__m")))
    salts = F.ceil(F.col("group_size") / stream)
    first = F.col("__id").eqNullSafe(F.col("keep_id"))
    dealt = pairs.where(F.octet_length("text") == F.col("nbytes")).select(*fp, "text", F.when(first, 0).otherwise(1).alias("role"), F.explode(F.when(first, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("__id"), salts)))).alias("salt"))
    shuffled = dealt.repartition(*[F.col(c) for c in (*fp, "salt")]).sortWithinPartitions(*fp, "salt", "role")
    differing = materialize(shuffled.mapInPandas(tidy(_differing), _FP).distinct(), "differing")

    told = rows.withColumn("__variant", F.lit(""))
    if not differing.isEmpty():  # texts of one fingerprint differ: those groups split by what the texts are
        told = rows.join(small(differing).withColumn("__odd", F.lit(True)), fp, "left").withColumn("__variant", F.when(F.col("__odd"), F.col("__sha")).otherwise("")).drop("__odd")
        again = told.groupBy(*fp, "__variant").agg(F.max("__id").alias("keep_id"), F.sum("__c").alias("group_size")).where("group_size > 1")
        held = small(materialize(again, "told-apart"))
        joined = told.join(held, [*fp, "__variant"], "left")
    else:
        joined = told.join(held, fp, "left")
    size = F.coalesce("group_size", F.col("__c"))
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    flat = joined.select(F.col("__id"), keep.alias("keep_id"), size.alias("group_size"), F.col("__sha"), F.explode(F.sequence(F.lit(1), F.col("__c"))).alias("__n"))
    return flat.select(F.col("__id").alias(id_col), "keep_id", "group_size", (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__n") == 1)).alias("kept"), F.col("__sha").alias("text_sha256"))
