"""Secret scanning with DataFrame functions only.

Patterns give the base spans. Beyond them, runs of hexadecimal or Base64 characters are candidate strings: a window
slides over each, keeping a count per character and the sum of ``c * log2(c)`` up to date as one character enters and
one leaves, so the Shannon entropy of every window is known in fixed-point numbers. Windows over their class's threshold
make a span, unless the string is on the allow list or a base span already covers it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of

#: The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")

#: Strings that look random and are no secrets: UUIDs, placeholders, alphabets.
ALLOW = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|sample|dummy|placeholder|x{6}|0123456|1234567|abcdef0|abcdefg"

SCALE = 1 << 20


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    alphabet: str
    least: int  #: characters of a candidate, and of the window
    bits: float  #: entropy of a window that makes a span

    @property
    def pattern(self) -> str:
        return f"[{self.alphabet.replace('-', '')}{'-' if '-' in self.alphabet else ''}]{{{self.least},}}"

    @property
    def log_sums(self) -> list[int]:
        """c * log2(c) for each count, in fixed point."""
        return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(self.least + 2)]

    @property
    def limit(self) -> int:
        """The sum of c * log2(c) is at most this where the entropy is at least ``bits``."""
        return math.floor((self.least * math.log2(self.least) - self.least * self.bits) * SCALE)


DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (EntropyClass("entropy_hex", DIGITS + "ABCDEF" + "abcdef", 16, 3.0), EntropyClass("entropy_base64", DIGITS + CAPITALS + SMALL + "+/_-", 20, 3.9))
_SPAN = "struct<start:int,end:int,value:string,part:string>"


def _running(values: Column, join: Callable[[Column, Column], Column], none: int) -> Column:
    """What each element and all before it give together: each pass doubles how far an element has looked."""
    n = F.size(values)
    levels = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def further(acc: Column, k: Column) -> Column:
        before = F.slice(F.concat(F.array_repeat(F.lit(none), F.pow(F.lit(2.0), k).cast("int")), acc), 1, F.size(acc))
        return F.zip_with(acc, before, lambda x, y: F.coalesce(join(x, y), F.lit(none)))

    return F.aggregate(levels, values, further)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed a single time."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: str, part: int = 0) -> Column:
    """Leftmost matches that do not overlap, with code point offsets: what lies between them gives the distances."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part))
    gaps = F.split(text, pattern, -1)

    def met(ms: Column) -> Column:
        pairs = F.zip_with(ms, parts, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
        return F.zip_with(pairs, F.slice(gaps, 1, F.size(ms)), lambda x, g: F.struct(x["m"].alias("m"), x["p"].alias("p"), F.length(x["m"]).alias("n"), F.length(g).alias("g")))

    def placed(xs: Column) -> Column:
        ends = _running(F.transform(xs, lambda x: x["g"] + x["n"]), lambda x, y: x + y, 0)
        return F.zip_with(xs, ends, lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["m"].alias("value"), x["p"].alias("part")))

    return F.when(text.rlike(pattern), _once(_once(whole, met), placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _windows(slots: Column, cls: EntropyClass) -> Column:
    """struct(first, last): offsets that the windows over the threshold cover, null without any.

    slots has the place in the alphabet of each character of a candidate.
    """
    sums = cls.log_sums
    grow = F.array(*[F.lit(b - a) for a, b in zip(sums, sums[1:])])  # what one more of a character adds

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = F.element_at(slots, i), F.when(i > cls.least, F.element_at(slots, F.greatest(i - cls.least, F.lit(1)))).otherwise(F.lit(0))
        more = F.get(grow, F.element_at(acc["counts"], enters))
        less = F.when((leaves > 0) & (leaves != enters), F.get(grow, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1))) - 1)).otherwise(F.lit(0))
        total = F.when(leaves == enters, acc["sum"]).otherwise(acc["sum"] + more - less)
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j + 1 == enters, 1).otherwise(0) - F.when(j + 1 == leaves, 1).otherwise(0))
        over = (i >= cls.least) & (total <= cls.limit)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(over & acc["first"].isNull(), i - cls.least).otherwise(acc["first"]).alias("first"),
            F.when(over, i).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"), F.lit(0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.size(slots)), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(text: Column, cls: EntropyClass) -> Column:
    found = F.filter(_matches(text, cls.pattern), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(ALLOW))
    placed = F.transform(found, lambda m: F.struct(m["start"].alias("at"), F.transform(F.split(m["value"], ""), lambda ch: F.instr(F.lit(cls.alphabet), ch)).alias("slots")))
    walked = F.transform(placed, lambda x: F.struct(x["at"].alias("at"), _windows(x["slots"], cls).alias("w")))
    over = F.filter(walked, lambda x: x["w"]["first"].isNotNull())
    return F.transform(over, lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), (x["at"] + x["w"]["last"]).alias("end")))


def _clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: all are walked in order, with the furthest end of others so far and
    the next start of others to come."""
    never = 1 << 30

    def walked(xs: Column) -> Column:
        ends = F.transform(xs, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(-1))
        starts = F.transform(F.reverse(xs), lambda x: F.when(x["own"] == 0, x["start"]).otherwise(never))
        furthest = _running(ends, lambda x, y: F.greatest(x, y), -1)
        following = F.reverse(_running(starts, lambda x, y: F.least(x, y), never))
        told = F.zip_with(F.zip_with(xs, furthest, lambda x, f: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["own"].alias("own"), f.alias("f"))), following, lambda x, n: F.struct(x.alias("x"), n.alias("n")))
        clear = F.filter(told, lambda t: (t["x"]["own"] == 1) & (t["x"]["f"] <= t["x"]["start"]) & (t["n"] >= t["x"]["end"]))
        return F.transform(clear, lambda t: F.struct(t["x"]["start"].alias("start"), t["x"]["end"].alias("end")))

    def of(own: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"))

    def apart(ss: Column) -> Column:
        both = F.sort_array(F.concat(F.transform(others, of(0)), F.transform(ss, of(1))))
        return F.when((F.size(ss) > 0) & (F.size(others) > 0), _once(both, walked)).otherwise(ss)

    return _once(spans, apart)


def secret_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans appended: arrays of struct(start, rank, kind, end), by start and then kind.

    Offsets count code points from 0, ends are exclusive. A null or empty text has no span; a run that matches several
    kinds is reported under each base kind it matches. Repeated rows are scanned alike and an empty table stays empty.
    Input columns of these names are replaced; all others pass through.
    """
    held = docs.drop("base_spans", "spans")
    text = text_of(text_col)

    def named(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = [F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_LEAST), _matches(text, ACCESS), _matches(text, HEX)]
    step = held.withColumn("base_spans", F.sort_array(F.concat(*[named(s, i, k) for i, (s, k) in enumerate(zip(base, BASE_KINDS, strict=True))])))
    taken = step.withColumn("spans", F.col("base_spans"))
    for i, cls in enumerate(CLASSES):
        taken = taken.withColumn("spans", F.concat("spans", named(_clear_of(_entropy_spans(text, cls), F.col("spans")), len(BASE_KINDS) + i, cls.kind)))
    return taken.withColumn("spans", F.sort_array("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
