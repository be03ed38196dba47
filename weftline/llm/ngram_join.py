"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes a set of word shingles; texts of equal sets form one class. In an order that puts the shingles known
to be frequent last, two sets that reach the threshold share at least l shingles within their l-prefixes. A class takes
a longer prefix (a larger l) where the counted frequencies of its shingles promise many candidates, and a pair must then
share min(l, l') prefix shingles before it is verified. The smaller set of a pair is matched by its shorter index
prefix, the larger by its probe prefix.

Links are needed only up to connectivity. First every shingle's classes are verified against one pivot of similar size,
then classes outside a shingle's main component against members of it that the shingle chooses; pairs that are joined by
then need no further look. The pairs left over, in different components, get the exact treatment. Before that, shingles
that stand in the same classes are folded into the first of them, so that a pair meets once for each list of classes and
not for each shingle of a shared passage.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.functions.graph import components
from weftline.llm.common import bounded_batches, materialize, row_key, small, take_worker, text_of, tidy
from weftline.llm.shingles import most_common, set_bits, set_key, set_words, shingle_sets

#: Shingles that a task counts at once, and how often one must occur there to be taken for frequent.
COUNTED, FREQUENT = 2_000_000, 3
#: Frequent shingles that are sent to all tasks; which ones are known changes the cost only, never the result.
KNOWN = 1 << 20
#: Largest number of shared shingles that may be asked for; costs of a prefix row, a posting met and a verification.
LONGEST, ROW, MEET, VERIFY = 6, 1.0, 1.0, 8.0
#: Postings of one shingle beyond which they are dealt to several buckets; members of a verification stream, and
#: streams for which a set is sent with one reading of its text.
SPLIT, STREAM, TOGETHER = 50_000, 500, 1000
#: Most turns in which shingles choose further members before all pairs left over are looked at.
TURNS = 3
#: Links whose components one task finds; rounds of small shuffles cost the driver more than the links do.
LINKS = 1 << 20
#: Shingles of a class that are looked through for an earlier meeting.
EARLIER = 24
#: Prefix rows of one bucket; bytes of sets in a batch on their way to verification.
BUCKET, SENT = 1_000_000, 4 << 20

_WORDS = tuple(f"w{i}" for i in range(8))
_POSTING = np.dtype([("t", "<u8"), ("k", "<i8"), ("n", "<i4"), ("p", "<i4"), ("l", "u1"), ("i", "u1")])
_PROFILE = "kind int, id long, k1 long, k2 long, n long, k long, other long, bits binary, " + ", ".join(f"{w} long" for w in _WORDS)
#: Salt of the second key of a set.
_OTHER = 0x2545F4914F6CDD1D


@dataclass(frozen=True)
class Terms:
    """Words of a shingle, the threshold num / den, the seed of word hashes, and the count beyond which postings are split."""

    width: int
    num: int
    den: int
    seed: int
    split: int


def _needed(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def choose_prefix(df: np.ndarray, n: int, num: int, den: int) -> tuple[int, int, int]:
    """l, index prefix and probe prefix for a set whose shingles have the estimated frequencies df, in prefix order.

    num/den is the threshold t. An equal or larger partner must share 2t/(1+t) of n, any partner t * n.
    """
    probe, index = n - _needed(n, num, den), n - _needed(2 * n * num, 1, num + den)
    most = min(LONGEST, _needed(n, num, den))
    met = np.cumsum(df[: index + most])
    costs = [(ROW * (probe + m) + met[min(n, index + m) - 1] * (MEET + VERIFY / m), m) for m in range(1, most + 1)]
    m = min(costs)[1]
    return m, min(n, index + m), min(n, probe + m)


def _profiles(terms: Terms) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of kind 0: a document's id, row key, and the size, keys and bitmaps of its set; of kind 1: a frequent shingle
    and its count in a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("ngram")
        held: list[np.ndarray] = []
        total, seen = 0, set()

        def frequent() -> pd.DataFrame:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT
            zero = dict.fromkeys(("k1", "k2", "other", *_WORDS), np.int64(0))
            own = {"kind": np.int32(1), "id": None, "n": counts[often].astype(np.int64), "k": values[often].view(np.int64), "bits": None}
            return pd.DataFrame(own | zero).astype({"id": "Int64"})

        for pdf in batches:
            sets = shingle_sets(pdf["text"].tolist(), terms.width, terms.seed)
            keys = [set_key(s) for s in sets]
            words = np.array([set_words(s) for s in sets], np.int64).reshape(-1, len(_WORDS))
            own = {
                "kind": np.int32(0),
                "id": pdf["id"].astype("Int64"),
                "k1": pdf["k1"],
                "k2": pdf["k2"],
                "n": np.array([len(s) for s in sets], np.int64),
                "k": np.array(keys, np.int64),
                "other": np.array([set_key(s, _OTHER) for s in sets], np.int64),
                "bits": [set_bits(s) for s in sets],
            }
            yield pd.DataFrame(own | {c: words[:, i] for i, c in enumerate(_WORDS)})
            for s, k in zip(sets, keys, strict=True):
                if len(s) and k not in seen:
                    seen.add(k)
                    held.append(s)
                    total += len(s)
            if total >= COUNTED:
                yield frequent()
                held, total, seen = [], 0, set()
        if held:
            yield frequent()

    return tidy(run)


def _parts(known: tuple[np.ndarray, np.ndarray], shingles: np.ndarray, split: int) -> np.ndarray:
    """To how many parts the postings of each shingle are dealt."""
    tokens, counts = known
    if not len(tokens):
        return np.ones(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
    return np.where(tokens[at] == shingles, -(-counts[at] // split), 1)


def _prefixes(terms: Terms, buckets: int, known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Prefix postings of each class met, in blocks by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("ngram")
        tokens, counts = known.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def dealt() -> pd.DataFrame:
            rows = np.concatenate(held)
            bucket = (rows["t"] >> np.uint64(33)).astype(np.int64)
            parts = _parts(known.value, rows["t"], terms.split)
            bucket += np.where(parts > 1, (rows["k"] & 0xFFFFFFFF) % parts, 0)
            bucket %= buckets
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            first = bucket[np.concatenate([[0], cuts])].astype(np.int32)
            return pd.DataFrame({"bucket": first, "block": [x.tobytes() for x in np.split(rows, cuts)]})

        for pdf in batches:
            for s in shingle_sets(pdf["text"].tolist(), terms.width, terms.seed):
                n = len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                df = np.zeros(n)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    df = np.where(tokens[at] == s, counts[at], 0).astype(float)
                order = np.argsort(df, kind="stable")  # s ascends, so ties go by hash
                m, index, probe = choose_prefix(df[order], n, terms.num, terms.den)
                rows = np.empty(probe, _POSTING)
                rows["t"], rows["k"], rows["n"] = s[order[:probe]], key, n
                rows["p"], rows["l"] = np.arange(probe), m
                rows["i"] = rows["p"] < index
                held.append(rows)
                total += probe
            if total >= 400_000:
                yield dealt()
                held, total = [], 0
            if len(seen) > 2_000_000:
                seen.clear()
        if held:
            yield dealt()

    return tidy(run)


def _pivots(terms: Terms, known) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From the blocks of each bucket: pairs with pivots (kind 0), the postings of shared shingles (kind 1), and all
    postings of shingles dealt to several parts (kind 2), of which a bucket can't tell whether they are shared."""
    num, den = terms.num, terms.den
    step = math.log(den / num)
    columns = ["kind", "x", "y", "n", "p", "l", "i"]

    def paired(blocks: list[bytes]) -> Iterator[pd.DataFrame]:
        rows = np.frombuffer(b"".join(blocks), _POSTING)
        rows = rows[np.lexsort((rows["k"], rows["n"], rows["t"]))]
        if len(rows) > 1:  # copies of a class that several tasks met
            rows = rows[np.concatenate([[True], (rows["t"][1:] != rows["t"][:-1]) | (rows["k"][1:] != rows["k"][:-1])])]
        edge = np.concatenate([[True], rows["t"][1:] != rows["t"][:-1]])
        run = np.cumsum(edge) - 1
        shared = (np.bincount(run) > 1) & (np.bincount(run, rows["i"]) > 0)
        dealt = _parts(known.value, rows["t"], terms.split) > 1
        kept = shared[run] | dealt
        rows, dealt = rows[kept], dealt[kept]
        if not len(rows):
            return
        own = {
            "kind": np.where(dealt, 2, 1).astype(np.int32),
            "x": rows["t"].astype(np.uint64).view(np.int64),
            "y": rows["k"],
            "n": rows["n"],
            "p": rows["p"],
            "l": rows["l"].astype(np.int32),
            "i": rows["i"].astype(np.int32),
        }
        yield pd.DataFrame(own)[columns]
        band = np.floor(np.log(rows["n"]) / step).astype(np.int64)
        edge = np.concatenate([[True], (rows["t"][1:] != rows["t"][:-1]) | (band[1:] != band[:-1])])
        run = np.cumsum(edge) - 1
        place = np.where(rows["i"] > 0, np.arange(len(rows)), len(rows))
        first = np.minimum.reduceat(place, np.flatnonzero(edge))[run]
        ok = first < np.arange(len(rows))
        a, b = rows[first[ok]], rows[ok]
        bound = np.minimum(a["n"] - a["p"], b["n"] - b["p"])
        needed = _ceil(num * (a["n"].astype(np.int64) + b["n"]), num + den)
        pairs = pd.DataFrame({"x": a["k"], "y": b["k"], "n": bound, "p": needed, "l": np.minimum(a["l"], b["l"]).astype(np.int32)})
        pairs = pairs.groupby(["x", "y"], as_index=False).agg(n=("n", "max"), p=("p", "first"), l=("l", "first"), i=("l", "size"))
        yield pairs.assign(kind=np.int32(0))[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take_worker("ngram")
        now, blocks = None, []
        for pdf in batches:
            for bucket, block in zip(pdf["bucket"], pdf["block"], strict=True):
                if bucket != now and blocks:
                    yield from paired(blocks)
                    blocks = []
                now = bucket
                blocks.append(block)
        if blocks:
            yield from paired(blocks)

    return tidy(run)


def _ceil(a: np.ndarray, b: int) -> np.ndarray:
    return (-(-a // b)).astype(np.int32)


def _sent(terms: Terms) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The set of each class asked for, once for every stream that needs it."""

    def rows(held: list[tuple]) -> pd.DataFrame:
        kinds = {"hub": "int64", "salt": "int64", "role": "int32", "k": "int64"}
        return pd.DataFrame(held, columns=["hub", "salt", "role", "k", "set"]).astype(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            sets = shingle_sets(pdf["text"].tolist(), terms.width, terms.seed)
            for s, k, to in zip(sets, pdf["k"], pdf["to"], strict=True):
                block = s.tobytes()
                for x in to:
                    held.append((x["hub"], x["salt"], x["role"], k, block))
                    size += len(block)
                    if size >= SENT:
                        yield rows(held)
                        held, size = [], 0
            yield rows(held)

    return tidy(run)


def _verified(num: int, den: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, base = None, np.empty(0, np.uint64)
        for pdf in batches:
            a, b = [], []
            for row in pdf.itertuples(index=False):
                s = np.frombuffer(row.set, np.uint64)
                if row.role == 0:
                    now, base = (row.hub, row.salt), s
                elif (row.hub, row.salt) == now:
                    at = np.minimum(np.searchsorted(base, s), len(base) - 1)
                    common = int(np.count_nonzero(base[at] == s))
                    if den * common >= num * (len(base) + len(s) - common):
                        a.append(row.hub), b.append(row.k)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return tidy(run)


@dataclass(frozen=True)
class Job:
    """Texts (id, text, k1, k2) and their classes (k, n, bits, words, head: the row that stands for the class)."""

    terms: Terms
    texts: DataFrame
    rows: DataFrame
    classes: DataFrame
    tallied: DataFrame

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose bitmaps allow the overlap that they need; no pair that has it is lost."""
        num, den = self.terms.num, self.terms.den

        @F.pandas_udf(T.BooleanType())
        def enough(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
            sides = zip(a, b, n, m, strict=True)
            return pd.Series([(num + den) * most_common(*x) >= num * (x[2] + x[3]) for x in sides], dtype=bool)

        sides = [self.classes.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "xy"]
        both = pairs.join(sides[0].hint("merge"), "x").join(sides[1].hint("merge"), "y")
        return both.where(enough("bits_x", "bits_y", "n_x", "n_y")).select("x", "y")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) of classes whose sets reach the threshold, as (a, b).

        The members y of a hub x are dealt to streams; a set goes to every stream that needs it.
        """
        count = F.count(F.lit(1))
        degree = pairs.groupBy("x").agg(count.alias("d")).select("x", F.ceil(F.col("d") / STREAM).alias("salts"))
        salted = pairs.join(degree.hint("merge"), "x")

        def one(hub: Column, salt: Column, role: int) -> Column:
            return F.struct(hub.alias("hub"), salt.alias("salt"), F.lit(role).alias("role")).alias("to")

        none = F.lit(0).cast("long").alias("part")
        members = salted.select(F.col("y").alias("k"), none, one(F.col("x"), F.pmod(F.xxhash64("y"), "salts"), 1))
        streams = degree.select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("s"))
        part = F.floor(F.col("s") / TOGETHER).alias("part")
        hubs = streams.select(F.col("x").alias("k"), part, one(F.col("x"), F.col("s"), 0))
        asked = members.union(hubs).groupBy("k", "part").agg(F.collect_list("to").alias("to"))
        heads = self.classes.select("k", F.col("head.k1").alias("k1"), F.col("head.k2").alias("k2")).hint("merge")
        asked = materialize(asked.join(heads, "k").select("k", "k1", "k2", "to"), "asked")
        found = self.texts.select("k1", "k2", "text").join(small(asked), ["k1", "k2"]).select("text", "k", "to")
        sets = found.mapInPandas(_sent(self.terms), "hub long, salt long, role int, k long, set binary")
        dealt = sets.repartition(F.col("hub"), F.col("salt")).sortWithinPartitions("hub", "salt", "role")
        return dealt.mapInPandas(_verified(self.terms.num, self.terms.den), "a long, b long").distinct()


def _shared(met: DataFrame) -> DataFrame:
    """The postings of shared shingles; those of a shingle dealt to several parts are counted over all of them."""
    dealt = met.where("kind = 2")
    counted = dealt.groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.max("i").alias("any"))
    shared = materialize(counted.where("d > 1 AND any > 0").select("x"), "shared-parts")
    return met.where("kind = 1").unionByName(dealt.join(small(shared), "x").select(*met.columns))


def _ranked(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of shared shingles with a, the shared shingles of the class before them; postings that cannot lead to a
    pair go.

    A shingle before a common one is known to both prefixes if it is common too. So of the p shingles before a posting
    only a can be common, and the set misses p - a for good: too many for a larger partner, or for any.
    """
    ranked = postings.withColumn("a", F.row_number().over(Window.partitionBy("y").orderBy("p")) - 1)
    left = F.col("n") - F.col("p") + F.col("a")
    index = (F.col("i") == 1) & (left * (num + den) >= F.col("n") * 2 * num)
    return ranked.where(left * den >= F.col("n") * num).withColumn("i", index.cast("int"))


def _folded(postings: DataFrame) -> DataFrame:
    """One shingle for each list of classes.

    The first of them in prefix order stands for all: it is the least bounded by its place, and the order is one for all
    classes, so the least place tells it. Shingles left with one posting, or with none in an index prefix, go. e has the
    shingles of the class before a posting, if they are among its first.
    """
    lists = postings.groupBy("x").agg(
        F.bit_xor(F.xxhash64("y")).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(11), "y")).alias("s2"),
        F.count(F.lit(1)).alias("d"),
        F.max("i").alias("any"),
        F.min("p").alias("p"),
    )
    same = lists.where("d > 1 AND any > 0").groupBy("s1", "s2", "d")
    first = same.agg(F.min(F.struct("p", "x")).alias("top")).select(F.col("top.x").alias("x"))
    kept = postings.join(first.hint("merge"), "x")
    placed = kept.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("p")))
    first = F.sort_array(F.collect_list(F.when(F.col("r") <= EARLIER, F.struct("p", "x"))).over(Window.partitionBy("y")))
    return placed.withColumn("e", F.transform(F.filter(first, lambda z: z["p"] < F.col("p")), lambda z: z["x"])).drop("r")


def _named(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of shingles that more than one component holds, with components and each shingle's main one."""
    named = postings.join(labels.hint("merge"), F.col("y") == F.col("k"), "left")
    named = named.select(F.col("x").alias("t"), "y", "n", "p", "a", "l", "i", "e", *_WORDS, F.coalesce("c", "y").alias("c"))
    by = named.groupBy("t", "c").agg(F.count(F.lit(1)).alias("d"))
    mixed = by.groupBy("t").agg(F.max(F.struct("d", "c")).alias("top"), F.count(F.lit(1)).alias("cs")).where("cs > 1")
    return materialize(named.join(mixed.select("t", F.col("top.c").alias("main")).hint("merge"), "t"), "mixed-postings")


def _sides(live: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, Column]:
    """Postings outside their shingle's main component, all postings, and whether two may be a pair by sizes, roles,
    places and bitmaps."""
    own = ("y", "n", "p", "a", "l", "i", "c", "e", *_WORDS)
    left = live.where("c <> main").select("t", *[F.col(x).alias(f"{x}1") for x in own])
    right = live.select("t", "main", *[F.col(x).alias(f"{x}2") for x in own])
    first = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("y1") < F.col("y2")))
    shared = F.least("l1", "l2")

    def roles(a: str, b: str) -> Column:
        """a is the smaller set: sizes fit, and the shingle stands in its index prefix and in b's probe prefix for what
        must be shared."""
        n, p, m, q = F.col(f"n{a}"), F.col(f"p{a}"), F.col(f"n{b}"), F.col(f"p{b}")
        index = (n - p + shared) * (num + den) > n * 2 * num
        probe = (m - q + shared) * den > m * num
        return (F.col(f"i{a}") == 1) & (n * den >= m * num) & index & probe

    fits = F.when(first, roles("1", "2")).otherwise(roles("2", "1"))
    most = F.least("a1", "a2") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    both = F.col("n1") + F.col("n2")
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{w}1").bitwiseXOR(F.col(f"{w}2"))) for w in _WORDS])
    return left, right, fits & (most * (num + den) >= both * num) & ((both - differ) * (num + den) >= both * 2 * num)


def _more_stars(live: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of a chosen member of each shingle's main component with the shingle's classes outside it.

    First that with the fewest shingles before it, which has the fewest that are its own, and is the nearest to most;
    then every shingle chooses at random, anew in each turn. So a class outside meets as many members as it has shingles.
    """
    left, right, fits = _sides(live, num, den)
    member = F.struct("y2", "n2", "p2", "a2", "l2", "i2", *[f"{w}2" for w in _WORDS])
    by = F.xxhash64("y2", "t", F.lit(turn))
    chosen = F.max_by(member, F.struct(-F.col("p2"), by) if turn == 0 else by).alias("h")
    hubs = right.where("c2 = main").groupBy("t").agg(chosen).select("t", "h.*")
    met = left.join(hubs.hint("merge"), "t").where(fits)
    return met.select(F.col("y2").alias("x"), F.col("y1").alias("y")).distinct()


def _residual(live: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (x, y) in different components.

    A pair that meets at several shingles is made at the first, if that is among the first of both: it fits there, or it
    is no pair.
    """
    left, right, fits = _sides(live, num, den)
    once = (F.col("c2") == F.col("main")) | (F.col("y1") < F.col("y2"))
    apart = (F.col("c1") != F.col("c2")) & once & fits & ~F.arrays_overlap("e1", "e2")
    met = left.join(right.hint("merge"), "t").where(apart)
    return met.select(F.least("y1", "y2").alias("x"), F.greatest("y1", "y2").alias("y")).distinct()


def _profiled(docs: DataFrame, width: int, num: int, den: int, split: int, text_col: str, id_col: str, seed: int | None) -> Job:
    """The rows and classes of docs, under a seed for which no two different sets share a key."""
    text = text_of(text_col)
    key = [c.alias(n) for c, n in zip(row_key(F.col(id_col).cast("long"), text), ("k1", "k2"), strict=True)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *key)
    while True:
        terms = Terms(width, num, den, secrets.randbits(63) if seed is None else seed, split)
        profiled = materialize(texts.mapInPandas(_profiles(terms), _PROFILE), "profiles")
        rows = profiled.where("kind = 0").select("id", "k1", "k2", "n", "k")
        head = F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")
        least = [F.min(c).alias(c) for c in ("n", "bits", *_WORDS)]
        grouped = profiled.where("kind = 0 AND n > 0").groupBy("k").agg(
            F.min(head).alias("head"), *least, F.min("other").alias("o1"), F.max("other").alias("o2")
        )
        classes = materialize(grouped, "classes")
        if classes.where("o1 <> o2").isEmpty():
            break
        seed = None
    tallied = materialize(profiled.where("kind = 1").groupBy("k").agg(F.sum("n").alias("d")), "frequent-shingles")
    return Job(terms, texts, rows, classes.drop("o1", "o2"), tallied)


def _known(tallied: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most KNOWN, in ascending order, and their counts."""
    spread = tallied.groupBy(F.floor(F.log2("d")).alias("e")).agg(F.count(F.lit(1)).alias("m"))
    sizes = {r["e"]: r["m"] for r in spread.collect()}  # a row per power of two
    least, total = 64, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= KNOWN:
        least -= 1
        total += sizes.get(least, 0)
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    top = tallied.where(F.col("d") >= 2**least).toPandas()
    tokens, counts = top["k"].to_numpy(np.int64).view(np.uint64), top["d"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _meet(job: Job) -> DataFrame:
    """What meets in the buckets of prefix shingles, see _pivots."""
    spark = job.texts.sparkSession
    known = spark.sparkContext.broadcast(_known(job.tallied))
    shingles = job.rows.agg(F.sum("n")).first()[0] or 0
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, -(-shingles * (job.terms.den - job.terms.num) // (job.terms.den * BUCKET)))
    blocks = job.texts.select("text").mapInPandas(_prefixes(job.terms, buckets, known), "bucket int, block binary")
    dealt = blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInPandas(_pivots(job.terms, known), "kind int, x long, y long, n int, p int, l int, i int"), "met")


def _labels(job: Job) -> DataFrame:
    """(k, c): the least class c reachable from each class k that has a link."""
    num, den = job.terms.num, job.terms.den
    met = _meet(job)
    # n holds the most that a pair can share, p what it must, i the prefix shingles that it does share
    pair = met.where("kind = 0").groupBy("x", "y")
    stars = pair.agg(F.max("n").alias("n"), F.first("p").alias("p"), F.first("l").alias("l"), F.sum("i").alias("i"))
    stars = materialize(job.plausible(stars.where("n >= p AND i >= l").select("x", "y")), "stars")
    near = materialize(job.verify(stars), "near")
    labels = components(near, LINKS)

    folded = _folded(materialize(_ranked(_shared(met), num, den), "ranked"))
    words = job.classes.select(F.col("k").alias("y"), *_WORDS)
    postings = materialize(folded.join(words.hint("merge"), "y"), "postings")
    live = _named(postings, labels)
    for turn in range(TURNS):
        more = materialize(job.plausible(_more_stars(live, turn, num, den)), "more-stars")
        found = materialize(job.verify(more), "more-near")
        if found.isEmpty():
            break
        near = near.union(found)
        labels = components(near, LINKS)
        live = _named(postings, labels)
    rest = materialize(job.plausible(_residual(live, num, den)), "residual")
    if rest.isEmpty():
        return labels
    further = materialize(job.verify(rest), "further")
    return labels if further.isEmpty() else components(near.union(further), LINKS)


def _grouped(docs: DataFrame, width: int, num: int, den: int, split: int, text_col: str, id_col: str, seed: int | None) -> DataFrame:
    """One row per input row: id, k1, k2 (its key), n, and top, the least row of its group (null without shingles)."""
    bounded_batches(docs.sparkSession)
    job = _profiled(docs, width, num, den, split, text_col, id_col, seed)
    grouped = job.classes.join(_labels(job).hint("merge"), "k", "left").select("k", "head", F.coalesce("c", "k").alias("c"))
    least = grouped.groupBy("c").agg(F.min("head").alias("top"))
    named = grouped.join(least.hint("merge"), "c").select(F.col("k").alias("__k"), "top.*")
    named = materialize(named.select("__k", F.col("id").alias("top_id"), F.col("k1").alias("t1"), F.col("k2").alias("t2")), "components")
    return job.rows.join(small(named), (F.col("k") == F.col("__k")) & (F.col("n") > 0), "left").drop("k", "__k")


def near_groups(
    docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, text_col: str = "text", id_col: str = "doc_id", split: int = SPLIT, seed: int | None = None
) -> DataFrame:
    """One row per input row: id_col (long), n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Two rows link when the Jaccard similarity of
    their sets of ``width``-word shingles is at least num/den; component_id is the least id reachable by links. A text
    of fewer words has its whole sequence as one shingle. A null, empty or blank text has no shingle and is a component
    of its own. Repeated rows link with each other; rows with a null id join components without naming them, and a
    component of null ids alone has a null component_id. An empty table gives an empty table; other columns are not
    read. Sets are compared by 64-bit hashes of their shingles under a random seed (or the one given); where two
    different sets share their key, which a second key tells, all is done again under another seed. ``split`` is the
    count of a shingle beyond which its postings are dealt to several tasks; it changes the cost only.
    """
    rows = _grouped(docs, width, num, den, split, text_col, id_col, seed)
    component = F.when(F.col("n") > 0, F.col("top_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(
    docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, text_col: str = "text", id_col: str = "doc_id", split: int = SPLIT, seed: int | None = None
) -> DataFrame:
    """docs with one row of each group, that of the least id (null ids last, ties by a hash of id and text); see
    near_groups for what a group is.

    Rows are told apart by id and text: different texts under one id are rows of their own, of rows equal in both one
    stays. Rows without shingles all stay. Other columns pass through.
    """
    rows = _grouped(docs, width, num, den, split, text_col, id_col, seed).where("n > 0")
    lost = (F.col("k1") != F.col("t1")) | (F.col("k2") != F.col("t2"))
    counted = rows.groupBy("k1", "k2").agg(F.max(lost).alias("lost"), F.count(F.lit(1)).alias("times"))
    named = materialize(counted.where("lost OR times > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "lost"), "near-copies")
    keyed = docs.select("*", *row_key(F.col(id_col).cast("long"), text_of(text_col)))
    on = ["__k1", "__k2"]
    left = keyed.join(small(named.where("lost").select(*on)), on, "left_anti")
    repeated = named.where("NOT lost").select(*on)
    if not repeated.isEmpty():
        once = left.join(small(repeated), on, "left_semi").dropDuplicates(on)
        left = left.join(small(repeated), on, "left_anti").unionByName(once)
    return left.select(*docs.columns)
