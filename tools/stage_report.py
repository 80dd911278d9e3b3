"""Summarise a Spark event log (as written by ``BENCH_EVENT_LOG=<dir>
python bench.py``): jobs, stages, tasks and time per stage call site.

    python tools/stage_report.py <event-log-dir> [top_n]
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh),
                                        encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main() -> None:
    root = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    files = sorted(glob.glob(os.path.join(root, "**", "events_*"), recursive=True)) or \
        sorted(glob.glob(os.path.join(root, "*")))
    jobs = 0
    stages = collections.defaultdict(lambda: [0, 0, 0])
    for f in files:
        if os.path.isdir(f):
            continue
        for line in _lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                jobs += 1
            elif e["Event"] == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                name = si["Stage Name"]
                site = name.split(" at ")[0] + " @ " + name.split(" at ")[-1][:60]
                s = stages[site]
                s[0] += 1
                s[1] += si["Number of Tasks"]
                s[2] += si.get("Completion Time", 0) - si.get("Submission Time", 0)
    total = sum(v[2] for v in stages.values())
    print(f"jobs {jobs}, stages {sum(v[0] for v in stages.values())}, "
          f"stage time {total / 1000:.1f}s")
    for site, (n, tasks, ms) in sorted(stages.items(), key=lambda kv: -kv[1][2])[:top]:
        print(f"{n:5d} stages {tasks:7d} tasks {ms / 1000:8.2f}s  {site}")


if __name__ == "__main__":
    main()
