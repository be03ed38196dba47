"""The two ladders that find field types in text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import types as T

_WHOLE = re.compile(r"\s*[+-]?\d+\s*$")
_FLOAT = re.compile(r"\s*[+-]?(\d[\d,]*(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")


def is_int(text: str, bits: int) -> bool:
    return bool(_WHOLE.match(text)) and -(1 << (bits - 1)) <= int(text) < 1 << (bits - 1)


def is_float(text: str) -> bool:
    return bool(_FLOAT.match(text))


def is_bool(text: str) -> bool:
    return text.strip().lower() in ("true", "false")


PLAIN = ((T.LongType(), lambda x: is_int(x, 64)), (T.DoubleType(), is_float), (T.BooleanType(), is_bool))
CATALOG = ((T.BooleanType(), is_bool), (T.IntegerType(), lambda x: is_int(x, 32)), (T.LongType(), lambda x: is_int(x, 64)), (T.DoubleType(), is_float))


def infer(values: Iterable[str | None], ladder=PLAIN) -> T.DataType:
    """The first type of the ladder that fits all values that aren't blank; text without any."""
    seen = [v for v in values if v is not None and v.strip()]
    return next((t for t, fits in ladder if seen and all(map(fits, seen))), T.StringType())
