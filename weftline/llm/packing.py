"""Packing into fixed windows by multiway Karmarkar-Karp differencing.

Documents are cut at the window size; what is left of each is an item. Items of a batch start as partial partitions of
k windows that hold one item. The two partials of the largest imbalance are merged again and again, the fullest windows
of one with the emptiest of the other, until one partition of near-equal windows is left. k starts as the least count
that can hold all ids and rises whenever a window exceeds the capacity; only documents longer than a window are cut.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, tidy
from weftline.llm.tokens import WORD_VOCABULARY, encoder

CAPACITY = 2048
#: Pieces of text remembered by a task, and MB of text in a batch; packing runs beside whatever else fills an executor.
REMEMBERED, TEXT_MB = 250_000, 1
#: Ids packed together; the count rises by one and by this part of the relative excess.
BATCH, RAISED = 1 << 18, 0.5

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items by window: a partition of them into k windows of near-equal sums.

    A partial partition lists its windows that aren't empty, fullest first, as (sum, items); items are nested pairs.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    if k == 1 or not heap:
        return [list(range(len(sizes)))] if k == 1 else [[] for _ in range(k)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = k - len(a)
        both = len(b) - free  # windows that are in use on either side
        if both <= 0:
            merged = a + b
        else:
            keep = len(a) - both
            merged = a[:keep] + [(x + y, (p, q)) for (x, p), (y, q) in zip(a[keep:], reversed(b[free:]), strict=True)] + b[:free]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    windows = []
    for _, tree in heap[0][2]:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                items.append(x)
        windows.append(items)
    return windows + [[] for _ in range(k - len(windows))]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length); every id of every item lies in exactly one piece.

    An item longer than a window fills windows of its own up to a rest, and no other item is cut. The window count rises
    as long as a window exceeds the capacity; the excess tells how far. Items of size 0 have no piece.
    """
    windows = [[(i, at, capacity)] for i, s in enumerate(sizes) for at in range(0, s - capacity + 1, capacity)]
    rest = [(i, s - s % capacity, s % capacity) for i, s in enumerate(sizes) if s % capacity]
    lengths = [x[2] for x in rest]
    k = -(-sum(lengths) // capacity)
    while k:
        placed = difference(lengths, k)
        fullest = max(sum(lengths[j] for j in w) for w in placed)
        if fullest <= capacity:
            return windows + [[rest[j] for j in w] for w in placed if w]
        k += 1 + int(RAISED * k * (fullest - capacity) / capacity)
    return windows


def _packed(vocabulary: str, capacity: int, batch: int, remembered: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = encoder(vocabulary, remembered)
        serial = TaskContext.get().partitionId() << 40
        names: list = []
        held: list[np.ndarray] = []
        total = 0

        def packed() -> pd.DataFrame:
            nonlocal serial
            rows = []
            for window in pack([len(x) for x in held], capacity):
                at = 0
                for i, start, length in window:
                    rows.append((names[i], start, length, zlib.crc32(held[i][start : start + length].tobytes()), len(held[i]), serial, at))
                    at += length
                serial += 1
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"} | dict.fromkeys(columns[1:], "int64"))

        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"].astype("Int64"), tok.documents(pdf["text"].tolist()), strict=True):
                names.append(doc_id)
                held.append(ids)
                total += len(held[-1])
                if total >= batch:
                    yield packed()
                    names, held, total = [], [], 0
        if held:
            yield packed()

    return tidy(run)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD_VOCABULARY, batch: int = BATCH, remembered: int = REMEMBERED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is a document: the ids of its text (none if null or empty) and the end id. Repeated rows are packed
    each for itself, a null id stays null, an empty table gives no pieces, and other columns are not read. A sequence
    holds at most ``capacity`` ids without gaps; documents of a batch of about ``batch`` ids share sequences, and a
    longer document is a batch with those before it. ``remembered`` pieces of text are kept by a process; fewer take
    less memory and more time, with the same result.
    """
    bounded_batches(docs.sparkSession, mb=TEXT_MB)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(_packed(vocabulary, capacity, batch, remembered), SCHEMA)
