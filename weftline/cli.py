"""weftline WORKFLOW.yaml [--validate]: check and run a workflow. Exit 0 done, 1 failed, 130 cancelled."""

from __future__ import annotations

import os
import signal
import sys

from weftline.plans.workflow import WorkflowError, load_workflow


def session(name: str, parallelism: int = 0):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if "SPARK_MASTER" not in os.environ and not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(f"local[{parallelism or '*'}]")
    return builder.getOrCreate()


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    only_check = "--validate" in args
    paths = [a for a in args if not a.startswith("--")]
    if not paths:
        print(__doc__)
        return 0
    if not os.path.isfile(paths[0]):
        print(f"file not found: {paths[0]}", file=sys.stderr)
        return 1
    try:
        workflow = load_workflow(paths[0])
        spark = session(workflow.name, workflow.settings.max_degree_of_parallelism)
        if only_check:
            from weftline.plans.planner import compile_workflow

            compile_workflow(spark, workflow, persist=False)
            print("valid")
            return 0
        from weftline.plans.runner import Runner

        runner = Runner(spark, workflow)
        try:
            signal.signal(signal.SIGINT, lambda *_: runner.cancel.request())
        except ValueError:
            pass  # not the main thread
        result = runner.run()
    except WorkflowError as e:
        for line in e.errors:
            print(f"error: {line}", file=sys.stderr)
        return 1
    for s in result.sinks.values():
        print(f"{s.node_id}: {'failed: ' + s.error if s.error else f'{s.rows} rows'}")
    return 130 if result.cancelled else 0


if __name__ == "__main__":
    sys.exit(main())
