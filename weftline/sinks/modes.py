"""Write modes, and files that take their place whole."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weftline.functions.values import ORD, c

_MODE = re.compile(r"\s*batchcommit\s*(?:\(\s*(\d+)\s*\)|:\s*(\d+))?\s*$", re.IGNORECASE)


@dataclass(frozen=True)
class WriteMode:
    transactional: bool = True
    batches: int = 1


def write_mode(text: str | None) -> WriteMode:
    """Transactional, BatchCommit, BatchCommit(n) or BatchCommit:n."""
    if not text or text.strip().lower() == "transactional":
        return WriteMode()
    m = _MODE.match(text)
    n = int(m[1] or m[2] or 1) if m else 0
    if n < 1:
        raise ValueError(f"unknown writeMode '{text}'")
    return WriteMode(False, n)


@contextmanager
def opened(path: str, mode: WriteMode, binary: bool = False) -> Iterator:
    """A file to write. Transactional: a file beside the target takes its place at the end and is deleted on an error."""
    local = re.sub(r"^file:(//)?", "", path)
    os.makedirs(os.path.dirname(os.path.abspath(local)), exist_ok=True)
    target = f"{local}.weftline-txn-{uuid.uuid4().hex}.tmp" if mode.transactional else local
    try:
        with open(target, "wb" if binary else "w", **({} if binary else {"encoding": "utf-8", "newline": "\n"})) as f:
            yield f
        if mode.transactional:
            os.replace(target, local)
    except BaseException:
        if mode.transactional and os.path.exists(target):
            os.remove(target)
        raise


def ordered(df: DataFrame) -> DataFrame:
    """Rows in their source's order, without the column that holds it."""
    return df.orderBy(c(ORD)).drop(ORD) if ORD in df.columns else df


def rows_of(df: DataFrame) -> Iterator:
    """Rows on the driver, a partition at a time, for formats that are one file by nature."""
    return df.toLocalIterator(prefetchPartitions=True)


Writer = Callable[[], int]
