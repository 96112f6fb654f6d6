"""Skew experiment: one product key holds a third of the line items (derived from lineitem).

Runs the per-product running sum of quantities two ways -- a single window over the key, and the
two-level scan of ``operators/running.py`` -- and reports, from Spark's event log, the wall time
and the longest task of the heaviest stage.  Usage:

    python tools/skew_experiment.py [sf_dir] [scratch_dir]
"""
import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from retailkit.operators.running import day_bucket, running_sum  # noqa: E402
from retailkit.sources.raw import read_raw  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
scratch = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="skew-")
logdir = os.path.join(scratch, "events")
os.makedirs(logdir, exist_ok=True)
spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
         .config("spark.sql.shuffle.partitions", "16").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

l = read_raw(spark, sf, "lineitem")
rows = l.select(
    F.when(F.col("l_orderkey") % 3 == 0, F.lit("HOT")).otherwise(F.col("l_partkey").cast("string")).alias("k"),
    "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
order = [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("q")]
variants = {
    "single_window": running_sum(rows, ["k"], order, "q", "run"),
    "two_level": running_sum(rows, ["k"], order, "q", "run", bucket=day_bucket("l_shipdate")),
}
result = {}
for rep in range(2):
    for name, df in variants.items():
        spark.sparkContext.setJobGroup(f"{name}-{rep}", name)
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        result.setdefault(name, {})["wall_s"] = round(time.perf_counter() - t, 3)
same = variants["single_window"].select("run").exceptAll(variants["two_level"].select("run")).count() == 0
spark.stop()

# event log: task durations per (job group, stage)
tasks, groups, stage_job = {}, {}, {}
def _lines(path):
    if path.endswith(".zstd"):
        import io
        import zstandard
        with open(path, "rb") as fh:
            return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8").readlines()
    with open(path) as fh:
        return fh.readlines()


for f in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
    if os.path.isdir(f) or os.path.basename(f).startswith("appstatus"):
        continue
    for line in _lines(f):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e.get("Stage IDs", []):
                stage_job[s] = g
        elif ev == "SparkListenerTaskEnd":
            info = e["Task Info"]
            tasks.setdefault(e["Stage ID"], []).append(info["Finish Time"] - info["Launch Time"])
for name in variants:
    stages = []
    for s_id in sorted(tasks):
        if stage_job.get(s_id) == f"{name}-1":
            ds = sorted(tasks[s_id])
            stages.append({"stage": s_id, "tasks": len(ds), "max_ms": ds[-1], "median_ms": ds[len(ds) // 2],
                           "sum_ms": sum(ds)})
    result[name]["stages"] = stages
    # the stage holding the window work is the one with the largest max/median spread or the largest sum
    result[name]["slowest_task_ms"] = max(st["max_ms"] for st in stages)
print(json.dumps({"sf": sf, "hot_key_share": "1/3", "same_result": same, "variants": result}))
