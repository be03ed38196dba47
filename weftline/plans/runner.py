"""Running a plan: one action per sink, error policies, error log, metrics, checkpoints and graceful cancel."""

from __future__ import annotations

import json
import os
import sys
import threading
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from weftline.plans.planner import Plan, compile_workflow
from weftline.plans.workflow import Workflow, WorkflowError


@dataclass
class SinkResult:
    node_id: str
    rows: int = 0
    seconds: float = 0.0
    error: str | None = None


@dataclass
class RunResult:
    sinks: dict[str, SinkResult] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)
    cancelled: bool = False

    @property
    def ok(self) -> bool:
        return not self.cancelled


class ErrorLog:
    """NDJSON lines {TimestampUtc, NodeId, Error}, appended on the driver."""

    def __init__(self, path: str):
        self.path = path

    def write(self, node_id: str, error: str) -> None:
        if not self.path:
            return
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"TimestampUtc": datetime.now(UTC).isoformat(), "NodeId": node_id, "Error": error}) + "\n")


class Metrics:
    """Rows and rows a second of each sink, to stderr and a JSON log, while running and at the end."""

    def __init__(self, path: str, interval: float):
        self.path, self.interval = path, interval
        self.began: dict[str, float] = {}
        self.done: dict[str, dict] = {}
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._tick, daemon=True)

    def _tick(self) -> None:
        while not self._stop.wait(self.interval):
            self.report()

    def __enter__(self) -> Metrics:
        if self.interval > 0:
            self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self.report()

    def start(self, node_id: str) -> None:
        self.began[node_id] = time.time()

    def finish(self, node_id: str, rows: int, errors: int) -> None:
        seconds = time.time() - self.began.pop(node_id)
        self.done[node_id] = {"node": node_id, "rowsOut": rows, "errors": errors, "rowsPerSecond": rows / max(1.0, seconds)}

    def report(self) -> None:
        rows = [*self.done.values(), *({"node": n, "running": True, "seconds": time.time() - b} for n, b in dict(self.began).items())]
        for r in rows:
            print("metrics " + json.dumps(r), file=sys.stderr)
        if self.path and rows:
            os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps({"TimestampUtc": datetime.now(UTC).isoformat(), "nodes": rows}) + "\n")


class Cancel:
    """First request: no further sink starts; second: running jobs are cancelled; third: exit with 130."""

    def __init__(self, spark: SparkSession, group: str, drain_seconds: float):
        self.spark, self.group, self.drain_seconds, self.requests = spark, group, drain_seconds, 0

    def request(self) -> None:
        self.requests += 1
        if self.requests == 1:
            timer = threading.Timer(self.drain_seconds, lambda: self.requests == 1 and self.request())
            timer.daemon = True
            timer.start()
        elif self.requests == 2:
            self.spark.sparkContext.cancelJobGroup(self.group)
        else:
            os._exit(130)


class Runner:
    def __init__(self, spark: SparkSession, workflow: Workflow):
        self.spark, self.workflow = spark, workflow
        self.log = ErrorLog(workflow.settings.error_log)
        self.cancel = Cancel(spark, f"workflow-{workflow.name}", workflow.settings.drain_timeout_seconds)

    def run(self) -> RunResult:
        plan = compile_workflow(self.spark, self.workflow)
        result = RunResult()
        for node_id, reason in plan.failed.items():
            result.errors.append((node_id, reason))
            self.log.write(node_id, reason)
        try:
            with Metrics(self.workflow.settings.metrics_log, self.workflow.settings.metrics_interval_seconds) as metrics:
                for node_id in plan.graph.order:
                    if node_id in plan.writers:
                        self._sink(plan, node_id, result, metrics)
            self._rejects(plan, result)
        finally:
            for df in plan.persisted:
                df.unpersist()
        return result

    def _sink(self, plan: Plan, node_id: str, result: RunResult, metrics: Metrics) -> None:
        if self.cancel.requests:
            result.cancelled = True
            return
        found = result.sinks[node_id] = SinkResult(node_id)
        metrics.start(node_id)
        began = time.time()
        self.spark.sparkContext.setJobGroup(self.cancel.group, f"sink {node_id}", interruptOnCancel=True)
        try:
            found.rows = plan.writers[node_id]()
            for up in plan.graph.upstream(node_id):
                for act in plan.contexts[up].after_commit if up in plan.contexts else ():
                    act()
        except Exception as e:  # noqa: BLE001 - the policies of the branch decide
            found.error = str(e).split("\n")[0]
            result.errors.append((node_id, found.error))
            self.log.write(node_id, found.error)
            if self.cancel.requests:
                result.cancelled = True
            elif all(plan.graph.nodes[x].error_policy == "StopPipeline" for x in plan.graph.upstream(node_id)):
                raise WorkflowError(f"sink '{node_id}': {found.error}") from e
        finally:
            found.seconds = time.time() - began
            metrics.finish(node_id, found.rows, int(found.error is not None))

    def _rejects(self, plan: Plan, result: RunResult) -> None:
        """Rejected rows of nodes that feed a sink that was written, one log line each."""
        if not self.log.path:
            return
        written = set().union(*[plan.graph.upstream(s.node_id) for s in result.sinks.values() if not s.error] or [set()])
        for node_id, ctx in plan.contexts.items():
            for message, df in ctx.rejects if node_id in written else ():
                for row in df.toLocalIterator():
                    self.log.write(node_id, message.format(**row.asDict()))


def run_workflow(spark: SparkSession, workflow: Workflow) -> RunResult:
    return Runner(spark, workflow).run()
