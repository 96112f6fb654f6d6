"""Plan audit: for every registered job, count shuffles and flag plan shapes that do not scale
(nested-loop or cartesian joins, Python evaluation, scans without pruning).

    python tools/plan_audit.py [sf_dir]

Only plans are built (no job runs), except for jobs that materialise a checkpoint or run a stream.
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retailkit.catalog import queries  # noqa: E402
from retailkit.session import build_session  # noqa: E402

FLAGS = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
         "MapInPandas", "FlatMapGroupsInPandas")

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = build_session()
for name, fn in sorted(queries().items()):
    if name.startswith("str0") or name == "win08_renumber_accounts":
        continue                                    # these run a stream / checkpoint when called
    plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    ex = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan))
    bc = len(re.findall(r"BroadcastExchange", plan))
    flags = [f for f in FLAGS if f in plan]
    print(f"{name:34s} shuffles={ex:2d} broadcasts={bc:2d} {' '.join(flags)}")
