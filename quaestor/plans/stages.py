"""Stage tables: finished parts of a run, kept so that a repeated run can go on from them."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from quaestor.params import params_hash
from quaestor.sources import fs


class StageStore:
    """Tables under ``<base>/<run_key>/<stage>/<frame>``.

    The run key is a hash of the parameters and the listing of the input files: another
    configuration or changed input never meets old stages. A stage counts as done once its
    manifest is committed, which happens after all its frames.
    """

    def __init__(self, spark: SparkSession, base: str, params, inputs: list[str]):
        self.spark = spark
        listed = [entry for path in inputs for entry in fs.listing(spark, path)]
        self.run_key = params_hash(params, listed)
        self.root = f"{base.rstrip('/')}/{self.run_key[:32]}"

    def _manifest(self, stage: str) -> str:
        return f"{self.root}/{stage}/_manifest"

    def is_done(self, stage: str) -> bool:
        return fs.exists(self.spark, f"{self._manifest(stage)}/_SUCCESS")

    def save(self, stage: str, frames: dict[str, DataFrame], metadata: dict | None = None) -> None:
        fs.remove(self.spark, f"{self.root}/{stage}")
        for name, df in frames.items():
            df.write.parquet(f"{self.root}/{stage}/{name}")
        row = (stage, datetime.now(timezone.utc).isoformat(), sorted(frames), json.dumps(metadata or {}))
        schema = "stage string, saved_at string, frames array<string>, metadata string"
        self.spark.createDataFrame([row], schema).coalesce(1).write.json(self._manifest(stage))

    def load(self, stage: str) -> dict[str, DataFrame]:
        """The frames of a finished stage; empty if it is not finished."""
        if not self.is_done(stage):
            return {}
        names = self.spark.read.json(self._manifest(stage)).first()["frames"]
        return {n: self.spark.read.parquet(f"{self.root}/{stage}/{n}") for n in names}

    def run(self, stage: str, build: Callable[[], dict[str, DataFrame]], resume: bool) -> dict[str, DataFrame]:
        """The frames of ``stage``: stored ones when resuming, else built, saved and read back."""
        if not (resume and self.is_done(stage)):
            self.save(stage, build())
        return self.load(stage)

    def clear(self) -> None:
        fs.remove(self.spark, self.root)
