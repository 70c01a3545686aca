"""Summarise jobs and stages from a Spark event log (no UI needed).

usage: python scripts/stage_times.py EVENT_LOG_DIR_OR_FILE

Run a session with spark.eventLog.enabled=true and spark.eventLog.dir set
to a scratch folder, then point this script at the folder. Prints, per job,
its start offset, duration and each stage's duration and task count.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    return raw.decode().splitlines()


def main() -> None:
    target = sys.argv[1]
    files = sorted(glob.glob(os.path.join(target, "**", "events*"), recursive=True)) or [target]
    stages, jobs = {}, {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            ev = e["Event"]
            if ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (
                    si["Completion Time"] - si["Submission Time"], si["Number of Tasks"],
                    si["Stage Name"].split(" at ")[0],
                )
            elif ev == "SparkListenerJobStart":
                jobs[e["Job ID"]] = [e["Submission Time"], e["Stage IDs"], None]
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]][2] = e["Completion Time"] - jobs[e["Job ID"]][0]
    if not jobs:
        print("no jobs found")
        return
    t0 = min(v[0] for v in jobs.values())
    for jid, (start, sids, dur) in sorted(jobs.items()):
        parts = [f"stage {s}: {stages[s][0]} ms / {stages[s][1]} tasks ({stages[s][2]})"
                 for s in sids if s in stages]
        print(f"job {jid:4d} +{(start - t0) / 1000:8.2f}s {dur} ms  " + "; ".join(parts))


if __name__ == "__main__":
    main()
