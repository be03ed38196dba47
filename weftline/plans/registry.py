"""Blocks by type name, and their parameters bound by name and annotation."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

ANY_PORT = "*"


class BindError(ValueError):
    pass


@dataclass
class BlockContext:
    """What a block sees: its inputs by port, the workflow's settings, and a place to report rejected rows."""

    spark: SparkSession
    node_id: str
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    settings: Any = None
    rejects: list[tuple[str, DataFrame]] = field(default_factory=list)
    after_commit: list[Callable[[], None]] = field(default_factory=list)

    @property
    def input(self) -> DataFrame:
        return self.inputs["in"]


@dataclass(frozen=True)
class BlockType:
    name: str
    kind: str
    build: Callable
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    #: Runtime parameters that a block accepts besides its signature.
    extras: tuple[str, ...] = ()

    def bind(self, params: dict[str, Any]) -> dict[str, Any]:
        """Arguments from a case-insensitive map of texts; all that is wrong is told at once."""
        given = {k.lower(): v for k, v in (params or {}).items()}
        out, wrong = {}, []
        for name, p in list(inspect.signature(self.build, eval_str=True).parameters.items())[1:]:
            value = given.get(name.lower())
            if value is None or (isinstance(value, str) and not value.strip() and p.annotation is not Char):
                if p.default is inspect.Parameter.empty:
                    wrong.append(f"parameter '{name}' is required")
                continue
            try:
                out[name] = convert(value, p.annotation)
            except ValueError as e:
                wrong.append(f"parameter '{name}': {e}")
        if wrong:
            raise BindError("; ".join(wrong))
        return out


class Char(str):
    """One character; of a longer text the first."""


def convert(value: Any, to: Any) -> Any:
    text = str(value).lower() if isinstance(value, bool) else str(value)
    if to in (str, str | None, inspect.Parameter.empty):
        return text
    if to is Char:
        if not text:
            raise ValueError("a character is required")
        return text[0]
    if to in (bool, bool | None):
        if text.strip().lower() not in ("true", "false"):
            raise ValueError(f"'{text}' is no boolean")
        return text.strip().lower() == "true"
    if to in (int, int | None):
        try:
            return int(text.strip())
        except ValueError:
            raise ValueError(f"'{text}' is no whole number") from None
    if to in (float, float | None):
        try:
            return float(text.strip().replace(",", ""))
        except ValueError:
            raise ValueError(f"'{text}' is no number") from None
    return value


REGISTRY: dict[str, BlockType] = {}


def block(name: str, kind: str = "transform", inputs: tuple[str, ...] = ("in",), outputs: tuple[str, ...] = ("out",)):
    """Register f(ctx, **params) under a type name; it returns a DataFrame, or DataFrames by port.

    A source has no inputs, and a sink returns a function that writes.
    """

    def register(f: Callable) -> Callable:
        REGISTRY[name.lower()] = BlockType(name, kind, f, () if kind == "source" else inputs, () if kind == "sink" else outputs)
        return f

    return register


def block_type(name: str) -> BlockType:
    load_blocks()
    if name.lower() not in REGISTRY:
        raise BindError(f"unknown block type '{name}'")
    return REGISTRY[name.lower()]


def load_blocks() -> None:
    import weftline.operators  # noqa: F401
    import weftline.sinks  # noqa: F401
    import weftline.sources  # noqa: F401
