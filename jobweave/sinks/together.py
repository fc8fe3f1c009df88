"""Independent writes submitted together, so small jobs share the cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

WIDTH = 8


def run_together(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> None:
    """Run independent jobs from a few threads; the first error is raised."""
    if len(jobs) < 2:
        for job in jobs:
            job()
        return
    with ThreadPoolExecutor(max_workers=min(WIDTH, len(jobs))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        for future in waiting:
            future.result()
