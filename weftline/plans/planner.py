"""Validation, and the fold of a workflow into DataFrames: one lazy plan per sink, no action but schema probes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import BindError, BlockContext, BlockType, block_type
from weftline.plans.workflow import Node, Workflow, WorkflowError


def split_ref(ref: str) -> tuple[str, str]:
    """node or node:port; the port is out by default."""
    node, _, port = ref.strip().partition(":")
    return node.strip(), port.strip() or "out"


@dataclass
class Graph:
    nodes: dict[str, Node]
    types: dict[str, BlockType]
    arguments: dict[str, dict]
    order: list[str]

    def upstream(self, node_id: str) -> set[str]:
        """The node and all that it reads from."""
        out, todo = set(), [node_id]
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += [split_ref(r)[0] for r in self.nodes[x].inputs.values()]
        return out

    def consumers(self) -> Counter:
        return Counter(split_ref(r)[0] for n in self.nodes.values() for r in n.inputs.values())


def check(workflow: Workflow) -> Graph:
    """The graph in topological order; raises WorkflowError with everything that is wrong."""
    errors: list[str] = []
    nodes: dict[str, Node] = {}
    for n in workflow.all_nodes():
        if not n.id.strip():
            errors.append("a node has an empty id")
        elif n.id in nodes:
            errors.append(f"node id '{n.id}' is used twice")
        else:
            nodes[n.id] = n
    if not workflow.sinks:
        errors.append("the workflow has no sink")
    types: dict[str, BlockType] = {}
    arguments: dict[str, dict] = {}
    sink_ids = {n.id for n in workflow.sinks}
    for n in nodes.values():
        try:
            t = types[n.id] = block_type(n.type)
            arguments[n.id] = t.bind(n.params)
        except BindError as e:
            errors.append(f"node '{n.id}': {e}")
            if n.id not in types:
                continue
        if (t.kind == "sink") != (n.id in sink_ids):
            errors.append(f"node '{n.id}': type '{n.type}' is a {t.kind} and listed under {'sinks' if n.id in sink_ids else 'nodes'}")
        given = {k.lower() for k in n.inputs}
        for port in sorted(given - set(t.inputs)):
            errors.append(f"node '{n.id}': unknown input port '{port}'; ports: {', '.join(t.inputs) or 'none'}")
        for port in t.inputs:
            if port not in given:
                errors.append(f"node '{n.id}': input '{port}' is required")
    for n in nodes.values():
        for port, ref in n.inputs.items():
            up, out = split_ref(ref)
            if up not in nodes:
                errors.append(f"node '{n.id}': input '{port}' reads unknown node '{up}'")
            elif up in types:
                ports = output_ports(types[up], arguments.get(up, {}))
                if types[up].kind == "sink":
                    errors.append(f"node '{n.id}': input '{port}' reads sink '{up}'")
                elif out.lower() not in ports:
                    errors.append(f"node '{n.id}': node '{up}' has no output port '{out}'; ports: {', '.join(ports)}")
    order: list[str] = []
    left = {i: {split_ref(r)[0] for r in n.inputs.values()} & nodes.keys() for i, n in nodes.items()}
    while ready := [i for i, ups in left.items() if not ups - set(order)]:
        order += ready
        for i in ready:
            del left[i]
    if left:
        errors.append(f"the workflow has a cycle through {', '.join(sorted(left))}")
    if errors:
        raise WorkflowError(errors)
    return Graph(nodes, types, arguments, order)


def output_ports(t: BlockType, arguments: dict) -> list[str]:
    if t.name == "TransformConditionalSplitter" and "branches" in arguments:
        from weftline.operators.attributes import branch_list

        try:
            return [name.lower() for name, _ in branch_list(arguments["branches"], arguments.get("delimiter", ";"))] + ["out"]
        except ValueError:
            return ["out"]
    return list(t.outputs)


@dataclass
class Plan:
    graph: Graph
    outputs: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    writers: dict[str, object] = field(default_factory=dict)
    contexts: dict[str, BlockContext] = field(default_factory=dict)
    #: Nodes whose plan failed under StopBranch or Ignore, with the reason, and the nodes that stop with them.
    failed: dict[str, str] = field(default_factory=dict)
    stopped: set[str] = field(default_factory=set)
    persisted: list[DataFrame] = field(default_factory=list)


def compile_workflow(spark: SparkSession, workflow: Workflow, persist: bool = True) -> Plan:
    """Fold the nodes into DataFrames. A node that can't be planned stops the pipeline, its branch or itself, by its policy."""
    graph = check(workflow)
    plan, errors = Plan(graph), []
    shared = graph.consumers()
    for node_id in graph.order:
        node, t = graph.nodes[node_id], graph.types[node_id]
        ups = {port.lower(): split_ref(ref) for port, ref in node.inputs.items()}
        if any(up in plan.stopped for up, _ in ups.values()):
            plan.stopped.add(node_id)
            continue
        ctx = BlockContext(spark, node_id, {}, workflow.settings)
        for port, (up, out) in ups.items():
            ports = {k.lower(): v for k, v in plan.outputs[up].items()}
            ctx.inputs[port] = ports[out.lower()]
        plan.contexts[node_id] = ctx
        try:
            made = t.build(ctx, **graph.arguments[node_id])
        except Exception as e:  # noqa: BLE001 - the policy of the node decides
            reason = str(e).split("\n")[0]
            if node.error_policy == "StopPipeline":
                errors.append(f"node '{node_id}': {reason}")
                plan.stopped.add(node_id)
            elif node.error_policy == "StopBranch" or t.kind != "transform":
                plan.failed[node_id] = reason
                plan.stopped.add(node_id)
            else:
                plan.failed[node_id] = reason
                plan.outputs[node_id] = {p: ctx.input.where(F.lit(False)) for p in output_ports(t, graph.arguments[node_id])}
            continue
        if t.kind == "sink":
            plan.writers[node_id] = made
            continue
        ports = made if isinstance(made, dict) else {"out": made}
        if persist and shared[node_id] > 1 and t.kind != "source":
            ports = {k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in ports.items()}
            plan.persisted += ports.values()
        plan.outputs[node_id] = ports
    if errors:
        raise WorkflowError(errors)
    return plan
