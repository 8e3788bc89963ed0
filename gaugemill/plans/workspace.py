"""Tables of one installation under a shared root folder."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.operators import lifecycle, tracking
from gaugemill.operators.textmodel import TrainingConfig
from gaugemill.sources import artifacts
from gaugemill.sources.tables import read_parquet_or_none

CHAMPION_SCHEMA = "seq bigint, flow_version_id string, run_id string"
MODEL_SCHEMA = (
    "run_id string, flow_name string, flow_version_id string, flow_config map<string,string>, "
    "input_schema map<string,string>, output_schema map<string,string>, label_mapping map<string,int>, "
    "training_rows bigint, evaluation_rows bigint, metrics map<string,double>, created_ns bigint"
)
ADAPTATION_SCHEMA = (
    "seq bigint, psi double, band string, action string, promoted boolean, champion_macro_f1 double, "
    "candidate_macro_f1 double, margin double, last_retrain_ts double, champion_version string, candidate_version string, "
    "ab_test_id string"
)
RETRAIN_SCHEMA = "last_retrain_ts double"


class NoChampion(RuntimeError):
    """Nothing has been promoted yet."""


def config_version_id(config: TrainingConfig) -> str:
    """Version id of one driver-side config; versions.config_version does whole tables."""
    return hashlib.sha256(json.dumps(config.params(), sort_keys=True).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str
    experiment_id: str | None = None
    flow_run_id: str = field(default_factory=tracking.mint_flow_run_id)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str, schema: str | None = None) -> DataFrame | None:
        return read_parquet_or_none(self.spark, self.path(name), schema)

    def append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(self.path(name))

    def experiment(self, base: str) -> str:
        return f"{self.experiment_id}:{base}" if self.experiment_id else base

    def log(self, experiment: str, run_name: str, params: Mapping = {}, metrics: Mapping = {}, tags: Mapping = {},
            run_id: str | None = None) -> str:
        own = {"flow_run_id": self.flow_run_id}
        if self.experiment_id:
            own["experiment_id"] = self.experiment_id
        return tracking.log_run(
            self.spark, self.path("tracking_runs"), self.experiment(experiment), run_name, params, metrics,
            {**tags, **own}, run_id,
        )

    def runs(self) -> DataFrame:
        found = self.table("tracking_runs", tracking.RUN_SCHEMA)
        return found if found is not None else self.spark.createDataFrame([], tracking.RUN_SCHEMA)

    def write_artifact(self, name: str, payload: object) -> None:
        artifacts.write_artifact(self.spark, self.path("artifacts"), self.flow_run_id, name, payload)

    def read_artifact(self, name: str):
        return artifacts.read_artifact(self.spark, self.path("artifacts"), self.flow_run_id, name)

    # champion log

    def champion(self) -> dict | None:
        log = self.table("champions", CHAMPION_SCHEMA)
        row = lifecycle.current_champion(log).first() if log is not None else None
        return row.asDict() if row is not None else None

    def require_champion(self) -> dict:
        live = self.champion()
        if live is None:
            raise NoChampion("no champion model promoted yet")
        return live

    def set_champion(self, flow_version_id: str, run_id: str) -> dict:
        """Append a promotion; promoting the live model again changes nothing."""
        live = self.champion()
        if live is None or live["run_id"] != run_id:
            self.append("champions", CHAMPION_SCHEMA, (time.time_ns(), flow_version_id, run_id))
        return self.champion()

    def rollback(self) -> dict | None:
        """Promote the previous champion again; None without one."""
        live = self.champion()
        if live is None or live["previous_run_id"] is None:
            return None
        return self.set_champion(live["previous_version"], live["previous_run_id"])

    # models

    def models(self) -> DataFrame:
        found = self.table("models", MODEL_SCHEMA)
        return found if found is not None else self.spark.createDataFrame([], MODEL_SCHEMA)

    def latest_model(self) -> str | None:
        return self.models().agg(F.max_by("run_id", "created_ns")).first()[0]

    def model_path(self, run_id: str) -> str:
        return self.path(f"model_files/run_id={run_id}")
