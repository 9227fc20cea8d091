"""Jobs in the background: so many at once, each in a Spark job group of its own, so that it can be cancelled."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from threading import Lock, Timer
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Runner:
    def __init__(self, spark: SparkSession, most: int = 2, timeout: float | None = None) -> None:
        self.spark, self.timeout = spark, timeout
        self.pool = ThreadPoolExecutor(most)
        self.states: dict[str, str] = {}
        self.lock = Lock()

    def run(self, name: str, job: Callable[[], Any]) -> Future:
        """Starts a job under a name that no unfinished one has; after the timeout it is cancelled."""
        with self.lock:
            if self.states.get(name) in ("waiting", "running"):
                raise ValueError(f"{name} is not finished")
            self.states[name] = "waiting"

        def body() -> Any:
            self.states[name] = "running"
            self.spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
            clock = Timer(self.timeout, self.cancel, (name,)) if self.timeout else None
            if clock:
                clock.start()
            try:
                out = job()
            except BaseException:
                self.states[name] = "cancelled" if self.states[name] == "cancelling" else "failed"
                raise
            finally:
                if clock:
                    clock.cancel()
            self.states[name] = "done"
            return out

        return self.pool.submit(inheritable_thread_target(self.spark)(body))

    def state(self, name: str) -> str:
        return self.states.get(name, "unknown")

    def cancel(self, name: str) -> bool:
        """Cancels the Spark jobs of a running job; whether it was running."""
        if self.state(name) != "running":
            return False
        self.states[name] = "cancelling"
        self.spark.sparkContext.cancelJobGroup(name)
        return True
