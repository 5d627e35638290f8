"""Work that runs beside the caller: its progress is told, and it can be stopped."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Status:
    """state: running, done, failed or stopped. jobs, stages and tasks: how many began, and how many tasks are over."""

    state: str
    jobs: int
    stages: int
    tasks: int
    tasks_done: int
    fault: str = ""


@dataclass
class Work:
    """A function that runs Spark jobs in a thread of its own, all under one group and one tag."""

    spark: SparkSession
    run: Callable[[], Any]
    name: str = "work"
    tag: str = field(default_factory=lambda: f"work-{uuid.uuid4().hex}")
    result: Any = None
    fault: str = ""
    stopped: bool = False

    def start(self) -> Work:
        def body() -> None:
            context = self.spark.sparkContext
            context.setJobGroup(self.tag, self.name, True)
            context.addJobTag(self.tag)
            try:
                self.result = self.run()
            except Exception as fault:  # told by status(), raised by wait()
                self.fault, self.cause = f"{type(fault).__name__}: {fault}"[:500], fault
            finally:
                context.removeJobTag(self.tag)

        self.cause: Exception | None = None
        self.thread: threading.Thread = InheritableThread(target=body, name=self.name, daemon=True)
        self.thread.start()
        return self

    def stop(self) -> None:
        """Cancel what runs and what would come; what was written as whole before stays."""
        self.stopped = True
        self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self.tag)
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> Any:
        self.thread.join(seconds)
        if self.thread.is_alive():
            raise TimeoutError(f"{self.name} still runs")
        if self.cause is not None:
            raise self.cause
        return self.result

    def status(self) -> Status:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = list(tracker.getJobIdsForGroup(self.tag))
        infos = [i for j in jobs if (i := tracker.getJobInfo(j))]
        stages = [s for i in infos for k in i.stageIds if (s := tracker.getStageInfo(k))]
        state = "running" if self.thread.is_alive() else "stopped" if self.stopped and self.fault else "failed" if self.fault else "done"
        return Status(state, len(jobs), len(stages), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), self.fault)
