"""Checkpoint files: a typed token {Type, Value} as JSON; a plain number or text is read too."""

from __future__ import annotations

import json
import os
from datetime import date, datetime
from decimal import Decimal
from typing import Any
from uuid import UUID

_READERS = {
    "int": int, "long": int, "decimal": Decimal, "double": float, "float": float, "string": str, "bool": lambda v: str(v).lower() == "true",
    "datetime": datetime.fromisoformat, "datetimeoffset": datetime.fromisoformat, "date": date.fromisoformat, "guid": UUID,
}


def type_of(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "long"
    if isinstance(value, float):
        return "double"
    if isinstance(value, Decimal):
        return "decimal"
    if isinstance(value, datetime):
        return "datetimeoffset" if value.tzinfo else "datetime"
    if isinstance(value, date):
        return "date"
    return "guid" if isinstance(value, UUID) else "string"


def write_token(path: str, value: Any) -> None:
    """Write beside the target and rename, so a reader sees the old or the new token."""
    kind = type_of(value)
    text = value.isoformat() if isinstance(value, (datetime, date)) else value if kind in ("long", "double", "bool") else str(value)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({"Type": kind, "Value": text}, f)
    os.replace(f"{path}.tmp", path)


def read_token(path: str | None) -> Any:
    """The token, or None without a file or text."""
    if not path or not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        text = f.read().strip()
    if not text:
        return None
    try:
        found = json.loads(text)
    except ValueError:
        return text
    if isinstance(found, dict) and "Type" in found:
        kind = str(found["Type"]).lower()
        if kind not in _READERS:
            raise ValueError(f"unknown checkpoint type '{found['Type']}'")
        return _READERS[kind](found["Value"])
    return found
