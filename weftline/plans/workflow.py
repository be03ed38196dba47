"""Workflows: the YAML model, its loader, and secrets from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

POLICIES = ("StopPipeline", "StopBranch", "Ignore")


class WorkflowError(ValueError):
    def __init__(self, errors: list[str] | str):
        self.errors = [errors] if isinstance(errors, str) else errors
        super().__init__("\n".join(self.errors))


@dataclass
class Settings:
    batch_size: int = 1000
    max_degree_of_parallelism: int = 0
    drain_timeout_seconds: int = 30
    spill_directory: str = ""
    spill_threshold_bytes: int = 1 << 30
    error_log: str = ""
    metrics_log: str = ""
    metrics_interval_seconds: int = 5
    grid_shift_directory: str = ""


@dataclass
class Node:
    id: str
    type: str
    inputs: dict[str, str] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    error_policy: str = "StopPipeline"


@dataclass
class Workflow:
    version: str
    name: str
    settings: Settings = field(default_factory=Settings)
    nodes: list[Node] = field(default_factory=list)
    sinks: list[Node] = field(default_factory=list)

    def all_nodes(self) -> list[Node]:
        return [*self.nodes, *self.sinks]


_SECRET = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def resolve_secrets(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """Replace ${NAME} in texts of a parsed document; all missing names are told at once."""
    env = os.environ if env is None else env
    missing: list[str] = []

    def walk(x: Any) -> Any:
        if isinstance(x, str):
            missing.extend(n for n in _SECRET.findall(x) if n not in env)
            return _SECRET.sub(lambda m: env.get(m[1], ""), x)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    out = walk(value)
    if missing:
        raise WorkflowError(f"environment variables are not set: {', '.join(sorted(set(missing)))}")
    return out


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def _scalars(x: Any, what: str, nested: tuple[str, ...] = ()) -> dict[str, Any]:
    if x is None:
        return {}
    if not isinstance(x, dict):
        raise WorkflowError(f"{what} must be a map")
    for k, v in x.items():
        if isinstance(v, (dict, list)) and k not in nested:
            raise WorkflowError(f"{what}.{k} must be a scalar")
    return {str(k): (str(v).lower() if isinstance(v, bool) else v if isinstance(v, (dict, list)) else "" if v is None else str(v)) for k, v in x.items()}


def _branches(value: Any) -> Any:
    """A list of {name, when} maps as the text form."""
    if not isinstance(value, list):
        return value
    return ";".join(f"{b.get('name') or b.get('port')}:{b.get('when') or b.get('expression')}" if len(b) > 1 else ";".join(f"{k}:{v}" for k, v in b.items()) for b in value)


def _node(x: Any) -> Node:
    if not isinstance(x, dict):
        raise WorkflowError("each node must be a map")
    policy = str(x.get("errorPolicy") or "StopPipeline")
    match = next((p for p in POLICIES if p.lower() == policy.lower()), None)
    if match is None:
        raise WorkflowError(f"node '{x.get('id')}': unknown errorPolicy '{policy}'")
    params = _scalars(x.get("params"), "params", ("branches",))
    if "branches" in params:
        params["branches"] = _branches(params["branches"])
    return Node(str(x.get("id") or ""), str(x.get("type") or ""), _scalars(x.get("inputs"), "inputs"), params, match)


def parse_workflow(text: str, env: Mapping[str, str] | None = None) -> Workflow:
    """A workflow from YAML text."""
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise WorkflowError("workflows in YAML need the yaml package") from e
    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise WorkflowError(f"not a YAML document: {e}") from e
    if not isinstance(doc, dict):
        raise WorkflowError("the document must be a map")
    doc = resolve_secrets(doc, env)
    errors = [f"'{k}' is required" for k in ("version", "name") if not str(doc.get(k) or "").strip()]
    if errors:
        raise WorkflowError(errors)
    settings = Settings()
    for k, v in (doc.get("settings") or {}).items():
        name = _snake(str(k))
        if hasattr(settings, name):
            try:
                setattr(settings, name, type(getattr(settings, name))(v))
            except (TypeError, ValueError):
                errors.append(f"settings.{k}: '{v}' does not fit")
    if errors:
        raise WorkflowError(errors)
    return Workflow(str(doc["version"]), str(doc["name"]), settings, [_node(n) for n in doc.get("nodes") or []], [_node(n) for n in doc.get("sinks") or []])


def load_workflow(path: str, env: Mapping[str, str] | None = None) -> Workflow:
    with open(path, encoding="utf-8") as f:
        return parse_workflow(f.read(), env)
