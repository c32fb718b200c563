"""Time limits on Spark actions, and settings from the size of the data."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


class TimeLimitExceeded(TimeoutError):
    """An action was cancelled because it took too long."""


def within(spark: SparkSession, seconds: float | None, action: Callable[[], T]) -> T:
    """The result of ``action``; once ``seconds`` are over its Spark jobs are cancelled and TimeLimitExceeded is raised."""
    if seconds is None:
        return action()
    tag, out = f"limit-{uuid.uuid4().hex}", {}

    def run() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out["value"] = action()
        except BaseException as error:  # handed to the caller
            out["error"] = error
        finally:
            spark.sparkContext.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    while thread.is_alive():  # an action may start another job after the first is cancelled
        spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(0.2)
    if late:
        raise TimeLimitExceeded(f"stopped after {seconds} seconds")
    if "error" in out:
        raise out["error"]
    return out["value"]


def tuned_partitions(spark: SparkSession, n_bytes: int, per_task: int = 128 << 20) -> int:
    """Shuffle partitions for so many bytes: tasks of about ``per_task``, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / per_task))
