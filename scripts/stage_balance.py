"""Stage balance from a Spark event log: per stage, the number of tasks, the
summed task time and the longest task, plus the stages that ran as a single
task. Set ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir`` to a
scratch folder, tag jobs with ``setJobDescription``, then:

    python scripts/stage_balance.py <event-log-dir> [top]
"""

from __future__ import annotations

import collections
import glob
import io
import json
import sys


def lines_of(path: str):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main(argv: list[str]) -> None:
    root, top = argv[0], int(argv[1]) if len(argv) > 1 else 15
    files = [f for f in glob.glob(f"{root}/**/*", recursive=True)
             if "events" in f.rsplit("/", 1)[-1] or f.endswith(".zstd")]
    tasks: dict[int, list[int]] = collections.defaultdict(list)
    job_of: dict[int, str] = {}
    for f in files:
        for line in lines_of(f):
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (e.get("Properties") or {}).get("spark.job.description", "")
                for s in e.get("Stage IDs", []):
                    job_of[s] = desc
            elif kind == "SparkListenerTaskEnd":
                info = e["Task Info"]
                tasks[e["Stage ID"]].append(info["Finish Time"] - info["Launch Time"])
    rows = sorted(((sum(t), s, job_of.get(s, ""), len(t), max(t)) for s, t in tasks.items()), reverse=True)
    print("total_ms  stage  tasks  max_task_ms  job")
    for total, s, job, n, mx in rows[:top]:
        print(f"{total:8d}  {s:5d}  {n:5d}  {mx:11d}  {job}")
    single = [r for r in rows if r[3] == 1]
    all_ms = sum(r[0] for r in rows) or 1
    print(f"single-task stages: {len(single)}, {sum(r[0] for r in single)} ms "
          f"({100 * sum(r[0] for r in single) / all_ms:.1f} % of task time)")


if __name__ == "__main__":
    main(sys.argv[1:])
