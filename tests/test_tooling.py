"""Plan inspection helpers and the event-log summariser."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from shelfwise.plans import inspect as P

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_inspect_helpers(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    agg = df.groupBy("k").count()
    assert P.has_operator(agg, "HashAggregate")
    assert P.single_partition_exchanges(df.agg(F.sum("id"))) == 1
    assert P.single_partition_exchanges(agg) == 0
    assert "HashAggregate" in P.physical_plan(agg)


def test_stage_times_script():
    folder = tempfile.mkdtemp(prefix="ev-")
    events = [
        {"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 1000, "Stage IDs": [0]},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {
            "Stage ID": 0, "Submission Time": 1005, "Completion Time": 1105,
            "Number of Tasks": 8, "Stage Name": "save at NativeMethodAccessorImpl.java:0"}},
        {"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": 1110},
    ]
    with open(os.path.join(folder, "events_1_app"), "w") as f:
        f.write("\n".join(json.dumps(e) for e in events))
    out = subprocess.run([sys.executable, os.path.join(REPO, "scripts", "stage_times.py"), folder],
                         capture_output=True, text=True, check=True).stdout
    assert "job    0" in out and "110 ms" in out and "100 ms / 8 tasks (save)" in out
