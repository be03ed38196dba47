"""Attribute transforms as Column expressions; all keep the hidden row order and geometry columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from weftline.functions.predicate import predicate
from weftline.functions.values import ORD, c, find_field, hidden, invariant_text, is_blank, is_geometry, is_number, lenient, parse_datetime, parse_double, trimmed, visible, with_field
from weftline.plans.registry import BlockContext, Char, block


def parts(text: str | None, delimiter: str = ",") -> list[str]:
    return [x.strip() for x in (text or "").split(delimiter) if x.strip()]


@block("TransformNoop")
def noop(ctx: BlockContext) -> DataFrame:
    return ctx.input


@block("TransformFilter")
def filter_rows(ctx: BlockContext, when: str) -> DataFrame:
    return ctx.input.where(predicate(when, ctx.input.schema))


def branch_list(branches: str, delimiter: str = ";") -> list[tuple[str, str]]:
    """(port, predicate) pairs of ``name:predicate;name:predicate``; delimiters inside quotes do not count."""
    out, piece, quote = [], "", ""
    for ch in branches + delimiter:
        if quote or ch in "\"'":
            quote = "" if quote == ch else quote or ch
        if ch == delimiter and not quote:
            if piece.strip():
                name, colon, text = piece.partition(":")
                if not colon or not name.strip() or not text.strip():
                    raise ValueError(f"branch '{piece.strip()}' is not of the form name:predicate")
                out.append((name.strip(), text.strip()))
            piece = ""
        else:
            piece += ch
    if not out:
        raise ValueError("branches are empty")
    if len({n.lower() for n, _ in out}) < len(out):
        raise ValueError("a branch name is used twice")
    return out


@block("TransformConditionalSplitter")
def conditional_splitter(ctx: BlockContext, branches: str, delimiter: Char = Char(";")) -> dict[str, DataFrame]:
    """Each row goes to the first branch that matches, else to out."""
    df, label = ctx.input, None
    named = branch_list(branches, delimiter)
    for name, text in named:
        p = predicate(text, df.schema)
        label = F.when(p, name.lower()) if label is None else label.when(p, name.lower())
    label = label.otherwise("out")
    return {port: df.where(label == port) for port in [n.lower() for n, _ in named if n.lower() != "out"] + ["out"]}


_CALCULATION = re.compile(r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*([+\-*/])\s*([+-]?\d+(?:\.\d+)?)\s*$")


def numeric(field: T.StructField) -> Column:
    """A field as a double, null where it is no number."""
    if is_number(field.dataType):
        return c(field.name).cast("double")
    return parse_double(invariant_text(c(field.name), field))


@block("TransformCalculator")
def calculator(ctx: BlockContext, expression: str, outputField: str) -> DataFrame:
    """A field and a constant; what is no number and a division by zero give 0."""
    m = _CALCULATION.match(expression)
    if not m:
        raise ValueError(f"'{expression}' is not of the form: field operator number")
    x, value = numeric(find_field(ctx.input.schema, m[1])), float(m[3])
    if m[2] == "/" and value == 0:
        result = F.lit(0.0)
    else:
        result = {"+": x + value, "-": x - value, "*": x * value, "/": x / (value or 1.0)}[m[2]]
    return with_field(ctx.input, outputField, F.coalesce(result, F.lit(0.0)))


@block("TransformSchemaMapper")
def schema_mapper(ctx: BlockContext, fields: str, rename: str | None = None, delimiter: Char = Char(",")) -> DataFrame:
    df, new = ctx.input, {}
    for pair in parts(rename, ";"):
        old, colon, name = pair.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"rename '{pair}' is not of the form old:new")
        new[find_field(df.schema, old).name.lower()] = name.strip()
    chosen = [find_field(df.schema, f) for f in parts(fields, delimiter)]
    if not chosen:
        raise ValueError("fields are empty")
    return df.select(*[c(f.name).alias(new.get(f.name.lower(), f.name), metadata=f.metadata) for f in chosen], *hidden(df))


@block("TransformStringManipulator")
def string_manipulator(ctx: BlockContext, field: str, operation: str, argument: str | None = None) -> DataFrame:
    """trim, upper, lower, prefix or suffix of a text field; other fields and operations pass through."""
    f, arg = find_field(ctx.input.schema, field), F.lit(argument or "")
    if not isinstance(f.dataType, T.StringType):
        return ctx.input
    x = c(f.name)
    made = {"trim": trimmed(x), "upper": F.upper(x), "lower": F.lower(x), "prefix": F.concat(arg, x), "suffix": F.concat(x, arg)}.get(operation.strip().lower())
    return ctx.input if made is None else with_field(ctx.input, f.name, made)


@block("TransformNullHandler")
def null_handler(ctx: BlockContext, field: str, defaultValue: str) -> DataFrame:
    f = find_field(ctx.input.schema, field)
    if not isinstance(f.dataType, T.StringType):
        return ctx.input
    return with_field(ctx.input, f.name, F.when(is_blank(c(f.name)), defaultValue).otherwise(c(f.name)))


def _typed(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Put text into a field: an existing one keeps its type and the text is read into it."""
    old = [f for f in df.schema.fields if f.name.lower() == name.lower()]
    return with_field(df, name, lenient(text, old[-1].dataType) if old else text)


@block("TransformRegexExtractor")
def regex_extractor(ctx: BlockContext, field: str, pattern: str, outputField: str, groupIndex: int = 1) -> DataFrame:
    """The group of the first match, ignoring case; empty without a match or such a group."""
    f = find_field(ctx.input.schema, field)
    groups = ctx.spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    text = F.regexp_extract(invariant_text(c(f.name), f), f"(?i){pattern}", groupIndex) if 0 <= groupIndex <= groups else F.lit("")
    return _typed(ctx.input, outputField, text)


@block("TransformDateTime")
def date_time(ctx: BlockContext, field: str, outputField: str = "datetime_utc") -> DataFrame:
    """A UTC time read from text, null where that fails; sinks write it in ISO 8601."""
    f = find_field(ctx.input.schema, field)
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = c(f.name).cast("timestamp")
    else:
        value = parse_datetime(invariant_text(c(f.name), f))
    return with_field(ctx.input, outputField, value)


@block("TransformValueLookup")
def value_lookup(ctx: BlockContext, field: str, mappings: str, outputField: str | None = None) -> DataFrame:
    """``src=dst;src=dst`` without regard to case; a value that isn't listed passes."""
    f, pairs = find_field(ctx.input.schema, field), {}
    for pair in parts(mappings, ";"):
        src, equal, dst = pair.partition("=")
        if not equal:
            raise ValueError(f"mapping '{pair}' is not of the form source=target")
        pairs[src.strip().lower()] = dst.strip()
    if not pairs:
        raise ValueError("mappings are empty")
    text = invariant_text(c(f.name), f)
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return _typed(ctx.input, outputField or f.name, F.coalesce(F.try_element_at(table, F.lower(text)), text))


FUNCTIONS = ("count", "sum", "avg", "min", "max")


def aggregate_list(text: str) -> list[tuple[str, str, str]]:
    """(function, field, output) of ``func:field[:alias]`` parts."""
    out = []
    for part in parts(text, ";"):
        x = [p.strip() for p in part.split(":")]
        if len(x) not in (2, 3) or not all(x):
            raise ValueError(f"aggregate '{part}' is not of the form function:field[:alias]")
        if x[0].lower() not in FUNCTIONS:
            raise ValueError(f"unknown aggregate function '{x[0]}'")
        if x[1] == "*" and x[0].lower() != "count":
            raise ValueError(f"'{x[0]}' needs a field")
        out.append((x[0].lower(), x[1], x[2] if len(x) == 3 else f"{x[0].lower()}_{'a' if x[1] == '*' else x[1]}"))
    if not out:
        raise ValueError("aggregates are empty")
    return out


@block("TransformAggregator")
def aggregator(ctx: BlockContext, groupBy: str, aggregates: str, delimiter: Char = Char(",")) -> DataFrame:
    """Groups in partial and final aggregation. An empty input gives no row, with or without keys."""
    df = ctx.input
    keys = [find_field(df.schema, k) for k in parts(groupBy, delimiter)]
    made, names = [], [k.name.lower() for k in keys]
    for function, field, name in aggregate_list(aggregates):
        if field == "*":
            col = F.count(F.lit(1))
        else:
            f = find_field(df.schema, field)
            x = c(f.name)
            if function == "count":
                col = F.count(F.when(~is_blank(x), 1)) if isinstance(f.dataType, T.StringType) else F.count(x)
            elif not is_number(f.dataType):
                raise ValueError(f"'{function}' needs a number field, '{f.name}' is none")
            else:
                col = getattr(F, function)(x.cast("double"))
        made.append(col.alias(name))
        names.append(name.lower())
    if len(set(names)) < len(names):
        raise ValueError("an output field name is used twice")
    if keys:
        return df.groupBy(*[c(k.name) for k in keys]).agg(*made)
    return df.agg(F.count(F.lit(1)).alias("__rows"), *made).where("__rows > 0").drop("__rows")


@block("TransformDeduplicateRecords")
def deduplicate(ctx: BlockContext, keyFields: str | None = None, delimiter: Char = Char(",")) -> DataFrame:
    """The first row of each key in the order of the source; by default all fields but geometries are the key."""
    df = ctx.input
    chosen = [find_field(df.schema, k) for k in parts(keyFields, delimiter)] or [f for f in df.schema.fields if f.name != ORD and not is_geometry(f)]
    if not chosen:
        return df.limit(1)
    if not hidden(df) and set(visible(df)) == {f.name for f in chosen}:
        return df.dropDuplicates()
    if not hidden(df):
        return df.dropDuplicates([f.name for f in chosen])
    # the least order and its row: partial aggregation keeps one row per key and task, so hot keys don't pile up
    row = F.min_by(F.struct(*[c(x) for x in visible(df)]), c(ORD))
    kept = df.groupBy(*[c(f.name).alias(f"__key{i}") for i, f in enumerate(chosen)]).agg(row.alias("__row"), F.min(c(ORD)).alias(ORD))
    return kept.select(*[F.col("__row")[f.name].alias(f.name, metadata=f.metadata) for f in df.schema.fields if f.name != ORD], c(ORD))


