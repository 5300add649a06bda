"""Decision log: one justified row a step."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "step int, operation string, parameters string, justification string, summary string, artifact string, at timestamp"


class TraceLog:
    def __init__(self):
        self.rows: list[tuple] = []

    def record(self, operation: str, parameters: dict, justification: str = "", summary: dict | None = None, artifact: str = "") -> None:
        self.rows.append((len(self.rows) + 1, operation, json.dumps(parameters, ensure_ascii=False, default=str), justification, json.dumps(summary or {}, default=str), artifact, datetime.now(timezone.utc)))

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.entries(spark).coalesce(1).write.mode("overwrite").json(path)

    def __len__(self) -> int:
        return len(self.rows)
