"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each rotated by the
letter's place; a text is the sum of its n-grams, and a language prototype the sum of its texts. A text goes to the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import bounded_batches, take_worker, tidy, worker_cache

DIMENSION, ORDER, SEED = 1024, 3, 20240607
#: Symbols: 0 for all that is no letter, a-z, and the other letters dealt over the rest.
SYMBOLS = 64
UNDETERMINED = "und"
#: n-gram vectors that a process keeps; those of rarer n-grams are made anew.
KEPT = 1 << 14

_SCORED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class NgramVectors:
    """Texts as n-gram counts, and n-gram counts as vectors; one a process."""

    held: NgramVectors | None = None

    def __init__(self) -> None:
        self.symbols = np.array([self._symbol(c) for c in range(0x20000)], np.int32)
        letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSION))
        self.placed = [np.roll(letters, ORDER - 1 - j, axis=1) for j in range(ORDER)]
        self.slots = np.full(SYMBOLS**ORDER, -1, np.int32)
        self.rows, self.used = np.empty((1024, DIMENSION), np.int8), 0

    @classmethod
    def get(cls) -> NgramVectors:
        take_worker("language")
        if cls.held is None:
            cls.held = cls()
        return cls.held

    @classmethod
    def forget(cls) -> None:
        cls.held = None

    @staticmethod
    def _symbol(code: int) -> int:
        if 97 <= code <= 122:
            return code - 96
        return 27 + code % (SYMBOLS - 27) if chr(code).isalpha() else 0

    def ngrams(self, text: str) -> np.ndarray:
        """Codes of the n-grams of a text, empty without letters; what lies between words counts as one symbol."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[np.minimum(codes, len(self.symbols) - 1)]
        if len(codes) and codes.max() >= len(self.symbols):
            far = codes >= len(self.symbols)
            s[far] = [self._symbol(int(c)) for c in codes[far]]
        s = np.concatenate([[0], s, [0]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        if len(s) < ORDER:
            return np.empty(0, np.int64)
        code = np.zeros(len(s) - ORDER + 1, np.int64)
        for j in range(ORDER):
            code = code * SYMBOLS + s[j : len(s) - ORDER + 1 + j]
        return code[s[1 : len(code) + 1] != 0]

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), DIMENSION), np.int8)
        for j in range(ORDER):
            out *= self.placed[j][codes // SYMBOLS ** (ORDER - 1 - j) % SYMBOLS]
        return out

    def bundle(self, ngrams: np.ndarray) -> np.ndarray:
        """The sum of the vectors of n-grams, exact in float64."""
        codes, counts = np.unique(ngrams, return_counts=True)
        new = codes[self.slots[codes] < 0][: KEPT - self.used]
        if len(new):
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = self._bound(new)
            self.slots[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        total = np.zeros(DIMENSION)
        for i in range(0, len(codes), 2048):
            slots, n = self.slots[codes[i : i + 2048]], counts[i : i + 2048]
            rows = self.rows[np.maximum(slots, 0)]
            if (slots < 0).any():
                rows[slots < 0] = self._bound(codes[i : i + 2048][slots < 0])
            exact = np.float32 if n.sum() < 1 << 24 else np.float64
            total += n.astype(exact) @ rows.astype(exact)
        return total


worker_cache("language", NgramVectors.forget)


@dataclass(frozen=True)
class Profiles:
    """Language names in order, and their prototypes scaled to length 1."""

    names: tuple[str, ...]
    vectors: np.ndarray

    def predict(self, text: Column) -> Column:
        """struct(lang_pred, score): und and 0 for null, letterless texts and without any profile; score is the cosine, at least 0."""
        names, vectors = self.names, self.vectors

        def one(texts: pd.Series) -> pd.DataFrame:
            make, out = NgramVectors.get(), []
            for t in texts:
                ngrams = make.ngrams(t) if t else np.empty(0, np.int64)
                if not len(ngrams) or not names:
                    out.append((UNDETERMINED, 0.0))
                    continue
                v = make.bundle(ngrams)
                cosines = vectors @ v / (np.linalg.norm(v) or 1.0)
                best = int(np.argmax(cosines))  # ties go to the first name
                out.append((names[best], float(min(1.0, max(0.0, cosines[best])))))
            return pd.DataFrame(out, columns=["lang_pred", "score"])

        @F.pandas_udf(_SCORED)
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from tidy(lambda parts: map(one, parts))(batches)

        # a filter on the result would be pushed below it with a copy of the call, and each text scored twice
        return scored.asNondeterministic()(text)


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the task's texts by language, one row a dimension."""
    make, sums = NgramVectors.get(), {}
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            ngrams = np.concatenate([make.ngrams(t) for t in part["text"]])
            sums[lang] = sums.get(lang, 0) + make.bundle(ngrams)
    for lang, total in sums.items():
        yield pd.DataFrame({"lang": lang, "d": np.arange(DIMENSION, dtype=np.int32), "v": np.rint(total).astype(np.int64)})


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from all rows whose text and language aren't null; sums are whole numbers, so their order is no matter.

    A language of letterless texts only has no profile. What reaches the driver is one vector a language.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInPandas(tidy(_bundles), "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).toPandas()
    names, vectors = [], []
    for lang, part in sums.sort_values(["lang", "d"]).groupby("lang"):
        v = part["v"].to_numpy(np.float64)
        if np.any(v):
            names.append(lang)
            vectors.append(v / np.linalg.norm(v))
    return Profiles(tuple(names), np.array(vectors) if vectors else np.empty((0, DIMENSION)))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score appended; input columns of these names are replaced, all others pass through."""
    bounded_batches(docs.sparkSession)
    held = docs.drop("lang_pred", "score")
    return held.withColumn("__scored", profiles.predict(F.col(text_col))).select(*held.columns, "__scored.lang_pred", "__scored.score")
