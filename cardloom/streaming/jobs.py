"""Background jobs: an append-only log of states, of which each job's last one holds."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, type string, status string, step int, created_at timestamp, updated_at timestamp, result_json string, error string"
INTERRUPTED = "interrupted by a restart"


class JobLog:
    """Jobs go from queued to running to succeeded or failed; each state is a row in a folder that all can read."""

    def __init__(self, spark: SparkSession, path: str, workers: int = 1):
        self.spark, self.path = spark, path.rstrip("/")
        self.pool = ThreadPoolExecutor(workers)

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def submit(self, type_: str, handler) -> tuple[str, Future]:
        """The new job's id, and a future that is done once its last state is written."""
        id_, began = uuid.uuid4().hex, datetime.now(timezone.utc)
        self._append([(id_, type_, "queued", 0, began, began, None, None)])

        def work():
            self._append([(id_, type_, "running", 1, began, datetime.now(timezone.utc), None, None)])
            status, result, error = "succeeded", None, None
            try:
                result = json.dumps(handler(), ensure_ascii=False)
            except Exception as e:  # noqa: BLE001  a job's fault is its result
                status, error = "failed", str(e) or "Job failed"
            self._append([(id_, type_, status, 2, began, datetime.now(timezone.utc), result, error)])

        return id_, self.pool.submit(work)

    def states(self) -> DataFrame:
        """The last state of each job."""
        log = self.spark.read.schema(SCHEMA).parquet(self.path)
        names = [c for c in log.columns if c != "id"]
        last = log.groupBy("id").agg(F.max_by(F.struct(*names), "step").alias("s"))
        return last.select("id", *[f"s.{c}" for c in names])

    def get(self, id_: str) -> DataFrame:
        return self.states().where(F.col("id") == id_)

    def listed(self) -> DataFrame:
        return self.states().orderBy(F.desc("created_at"), "id")

    def recover(self) -> None:
        """After a restart: what was queued or running has failed."""
        open_ = self.states().where("status in ('queued', 'running')")
        done = open_.withColumns({"status": F.lit("failed"), "step": F.lit(2), "updated_at": F.current_timestamp(), "error": F.lit(INTERRUPTED)})
        done.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(self.path)
