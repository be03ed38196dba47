"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

Documents and benchmark windows are sets of word shingles. The shingles of all windows are joined with those of the
documents once; the counts found order shingles by rarity. As a window must be contained whole, its necessary prefix is
its single rarest shingle, and a window with a shingle that no document has is out. Each place of a prefix shingle puts
its windows at one place of the document, within the bounds of the text, where they are verified over their whole
length. Equal windows are one, however many items or places of an item have them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, materialize, row_key, small, text_of

#: What lies between words: ASCII that is neither a letter nor a digit, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Windows of an item that are made in one row; longer items are taken in parts.
PART = 2000


def words(text: Column) -> Column:
    """The words of a text; only the first and the last piece between separators can be empty."""

    def inner(p: Column) -> Column:
        head = F.when(p[0] == "", 1).otherwise(0)
        return F.slice(p, head + 1, F.greatest(F.size(p) - head - F.when(F.element_at(p, -1) == "", 1).otherwise(0), F.lit(0)))

    return F.transform(F.array(F.split(ascii_lower(text), BETWEEN, -1)), inner)[0]  # one element, so that the text is split once


def _shingles(ws: Column, size: int) -> Column:
    """A 64-bit hash of each run of size words."""
    last = F.size(ws) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(size), *[ws[i + j] for j in range(size)])))


def _name(ws: Column) -> list[Column]:
    """128 bits that stand for a run of words."""
    return [F.xxhash64(F.size(ws), ws).alias("a"), F.xxhash64(F.lit(29), ws, F.size(ws)).alias("b")]


def benchmark_windows(benchmark: DataFrame, window: int, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """One row per window of an item: __item (id as string), __len, __s (size of its shingles), a, b (its name), and
    __hs, the hashes of its shingles in their order."""
    ws = words(text_of(text_col))
    items = benchmark.select(ws.alias("__iw"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__item"))
    length = F.least(F.size("__iw"), F.lit(window))
    sized = items.where(F.size("__iw") > 0).select("*", length.alias("__len"), F.least(length, F.lit(SHINGLE)).alias("__s"))
    count = F.size("__iw") - F.col("__len") + 1
    begins = F.explode(F.sequence(F.lit(0), count - 1, F.lit(PART)))
    parts = sized.select("__item", "__len", "__s", "__iw", begins.alias("__b"))
    cut = F.slice("__iw", F.col("__b") + 1, F.col("__len") + F.lit(PART - 1)).alias("__iw")

    def there(size: int) -> Column:
        """The windows of a part whose shingles have so many words."""
        shingles = F.col("__len") - size + 1
        places = F.sequence(F.lit(0), F.size("__iw") - F.col("__len"))
        return F.transform(places, lambda i: F.struct(*_name(F.slice("__iw", i + 1, F.col("__len"))), F.slice("__all", i + 1, shingles).alias("hs")))

    by_size = []
    for size in range(1, SHINGLE + 1):
        own = parts.where(F.col("__s") == size).select("__item", "__len", "__s", cut)
        own = own.select("*", _shingles(F.col("__iw"), size).alias("__all"))
        by_size.append(own.select("__item", "__len", "__s", F.explode(there(size)).alias("__x")))
    every = reduce(DataFrame.union, by_size)
    return every.select("__item", "__len", "__s", "__x.a", "__x.b", F.col("__x.hs").alias("__hs"))


def _candidates(keyed: DataFrame, text: Column, every: DataFrame) -> DataFrame:
    """Where windows may stand: __k1, __k2, __c (array of struct(at, n, a, b)) of each row that has any."""
    windows = materialize(every.groupBy("a", "b", "__len", "__s").agg(F.first("__hs").alias("__hs")), "windows")
    sizes = sorted(r[0] for r in windows.select("__s").distinct().collect())  # at most SHINGLE values
    known = small(materialize(windows.select(F.explode("__hs").alias("__h")).distinct(), "window-shingles"))
    # words are taken apart once a row, in a step of its own
    split = keyed.select("__k1", "__k2", words(text).alias("__w"))
    branches = [split.select("__k1", "__k2", F.posexplode(_shingles(F.col("__w"), s)).alias("__p", "__h")) for s in sizes or [1]]
    met = materialize(reduce(DataFrame.union, branches).join(known, "__h"), "shingles-met")

    rarity = materialize(met.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")), "rarity")
    held = windows.select("a", "b", "__len", F.posexplode("__hs").alias("__o", "__h"))
    counted = held.join(small(rarity), "__h", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    rarest = counted.groupBy("a", "b", "__len").agg(F.min(F.struct("__n", "__h", "__o")).alias("__x")).where("__x.__n > 0")
    prefix = materialize(rarest.select(F.col("__x.__h").alias("__h"), F.col("__x.__o").alias("__o"), "a", "b", "__len"), "prefixes")
    at = F.col("__p") - F.col("__o")
    placed = met.join(small(prefix), "__h").where(at >= 0)
    one = F.struct(at.alias("at"), F.col("__len").alias("n"), F.col("a"), F.col("b"))
    return materialize(placed.groupBy("__k1", "__k2").agg(F.collect_set(one).alias("__c")), "candidates")


def find_windows(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """docs with n_words, hits (array of word positions from 0), items (sorted array of item ids as strings) appended.

    A word is a run of ASCII letters and digits and of any code points beyond ASCII, A-Z lower-cased. A window is
    ``window`` consecutive words of an item, or all words of a shorter item; hits are the words of a document inside any
    occurrence of any window. Windows are compared by 128 bits of all their words. Null texts have no words, items
    without words have no windows, and a null item id is listed as an empty string. Repeated rows get equal results,
    repeated items are found once, and an empty benchmark hits nothing. Input columns named n_words, hits or items are
    replaced; all others pass through.
    """
    held = docs.drop("n_words", "hits", "items")
    text = text_of(text_col)
    keyed = held.select("*", *row_key(F.col(id_col), text))
    on = ["__k1", "__k2"]
    every = materialize(benchmark_windows(benchmark, window, item_text, item_id), "item-windows")
    candidates = _candidates(keyed, text, every)

    def verified(w: Column) -> Column:
        """The candidates that the words have at their places."""

        def there(c: Column) -> Column:
            a, b = _name(F.slice(w, c["at"] + 1, c["n"]))
            return (c["at"] + c["n"] <= F.size(w)) & (a == c["a"]) & (b == c["b"])

        return F.filter("__c", there)

    near = keyed.select(*on, text.alias("__text")).join(small(candidates), on)
    # one element, so that the text is split once and not for each candidate
    checked = near.select(*on, F.transform(F.array(words(F.col("__text"))), verified)[0].alias("__v"))
    found = materialize(checked.dropDuplicates(on), "windows-checked").where(F.size("__v") > 0)
    of_items = every.select("a", "b", "__item").distinct()
    named = found.select(*on, F.explode("__v").alias("__x")).select(*on, "__x.a", "__x.b").distinct().join(of_items, ["a", "b"])
    items = named.groupBy(*on).agg(F.collect_set("__item").alias("__items"))
    hits = F.flatten(F.transform("__v", lambda v: F.sequence(v["at"], v["at"] + v["n"] - 1)))
    hit = found.select(*on, F.array_sort(F.array_distinct(hits)).alias("__hits")).join(items.hint("merge"), on)
    out = keyed.join(small(materialize(hit, "hits")), on, "left")
    return out.select(
        *held.columns,
        F.size(words(text)).cast("long").alias("n_words"),
        F.coalesce("__hits", F.array().cast("array<int>")).alias("hits"),
        F.array_sort(F.coalesce("__items", F.array().cast("array<string>"))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, **options) -> DataFrame:
    """The documents without any hit, in their own columns; see find_windows for what a hit is."""
    return find_windows(docs, benchmark, window, **options).where(F.size("hits") == 0).select(*docs.columns)
