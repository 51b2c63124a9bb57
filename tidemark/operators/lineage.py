"""Which metrics a metric's rollups feed, by hops over job edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import aggregates
from .rollup import Job

SCHEMA = "hop int, db string, metric string, aggregate string, job_id string"
MAX_HOPS = 5


def downstream(jobs: Sequence[Job], db: str, metric: str, max_hops: int = MAX_HOPS) -> tuple[list[tuple], bool]:
    """Rows of SCHEMA in order, and whether more hops would give more. Pattern jobs are not followed; nothing is visited twice."""
    if not 1 <= max_hops <= MAX_HOPS:
        raise ValueError(f"max_hops must be from 1 to {MAX_HOPS}")
    seen, front, out = {(db, metric)}, [(db, metric)], []
    for hop in range(1, max_hops + 1):
        following = []
        for at in front:
            for j in jobs:
                if j.source_metric and (j.source_db, j.source_metric) == at:
                    for a in j.aggregates:
                        a = aggregates.CANONICAL.get(a, a)
                        target = j.destination_db, f"{j.prefix or j.source_metric}.{a}"
                        if target not in seen:
                            seen.add(target)
                            following.append(target)
                            out.append((hop, *target, a, j.id))
        front = following
    truncated = any(j.source_metric and (j.source_db, j.source_metric) in set(front) for j in jobs)
    return sorted(out), truncated


def lineage(spark: SparkSession, jobs: Sequence[Job], db: str, metric: str, max_hops: int = MAX_HOPS) -> DataFrame:
    return spark.createDataFrame(downstream(jobs, db, metric, max_hops)[0], SCHEMA)
