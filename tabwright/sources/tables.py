"""The result store: append-only Parquet tables with removals kept as key lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators.usage import upserted

# Columns of the stored documents.
SCHEMAS = {
    "leaderboard": (
        "user_id string, model_id string, algorithm string, problem_type string, dataset_name string, "
        "target_column string, metrics map<string,double>, "
        "feature_importance array<struct<feature:string,importance:double>>, duration_sec double, "
        "eval_mode string, num_features int, num_samples long, created_at timestamp"
    ),
    "snapshots": (
        "user_id string, snapshot_id string, name string, dataset_name string, target_column string, "
        "problem_type string, row_count long, col_count int, "
        "models_summary array<struct<algorithm:string,score:double>>, key_metrics map<string,double>, "
        "fingerprint string, state string, saved_at timestamp"
    ),
    "activity": "user_id string, email string, action string, details string, created_at timestamp",
    "history": (
        "problem_type string, best_model_id string, best_algorithm string, num_samples long, num_features int, "
        "target_column string, total_time double, text_columns array<string>, numeric_columns array<string>, "
        "created_at timestamp"
    ),
    "deployments": (
        "deploy_id string, model_id string, user_id string, name string, description string, created_at timestamp"
    ),
    "scoring_log": "deploy_id string, n_rows long, created_at timestamp",
}
USER_TABLES = ("snapshots", "leaderboard", "activity", "deployments")


class ResultStore:
    """Tables under one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _raw(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows, in the table's columns."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        typed = df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in empty.schema
            ]
        )
        typed.write.mode("append").parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        """Rows not removed since they were written."""
        time = "saved_at" if name == "snapshots" else "created_at"
        rows = self._raw(name, SCHEMAS[name])
        for keys in (["user_id"], ["user_id", self._id(name)]):
            if not all(k in rows.columns for k in keys):
                continue
            schema = ", ".join(f"{k} string" for k in keys) + ", removed_at timestamp"
            gone = self._raw(f"{name}_removed_{len(keys)}", schema).groupBy(*keys).agg(F.max("removed_at").alias("_gone"))
            rows = rows.join(gone, keys, "left").where(F.col("_gone").isNull() | (F.col(time) > F.col("_gone"))).drop("_gone")
        return rows

    @staticmethod
    def _id(name: str) -> str:
        return {"leaderboard": "model_id", "snapshots": "snapshot_id", "deployments": "deploy_id"}.get(name, "details")

    def remove(self, name: str, user_id: str, entry_id: str | None = None) -> None:
        """Remove one entry of a user, or all of them; a row in a small key list, no rewrite."""
        keys = [("user_id", user_id)] + ([(self._id(name), entry_id)] if entry_id else [])
        row = self.spark.range(1).select(
            *[F.lit(v).alias(k) for k, v in keys], F.current_timestamp().alias("removed_at")
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}_removed_{len(keys)}")

    def remove_user(self, user_id: str) -> None:
        for name in USER_TABLES:
            self.remove(name, user_id)

    def save_leaderboard(self, entries: DataFrame) -> None:
        self.append("leaderboard", entries.withColumn("created_at", F.current_timestamp()))

    def leaderboard(self, user_id: str) -> DataFrame:
        """A user's entries, newest first."""
        return self.read("leaderboard").where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "model_id")

    def save_snapshot(self, snapshot: DataFrame) -> None:
        """Store one more state; a later one with the same user and fingerprint takes its place on reading."""
        self.append("snapshots", snapshot.withColumn("saved_at", F.current_timestamp()))

    def snapshots(self, user_id: str, limit: int = 50) -> DataFrame:
        """The newest snapshots of a user without their state."""
        own = self.read("snapshots").where(F.col("user_id") == user_id).drop("state")
        return upserted(own, ["user_id", "fingerprint"], "saved_at", "snapshot_id").orderBy(F.desc("updated_at")).limit(limit)

    def snapshot(self, user_id: str, fingerprint: str) -> DataFrame:
        own = self.read("snapshots").where((F.col("user_id") == user_id) & (F.col("fingerprint") == fingerprint))
        return upserted(own, ["user_id", "fingerprint"], "saved_at", "snapshot_id")

    def log_activity(self, user_id: str, email: str, action: str, details: str = "") -> None:
        row = self.spark.createDataFrame([(user_id, email, action, details)], "user_id string, email string, action string, details string")
        self.append("activity", row.coalesce(1).withColumn("created_at", F.current_timestamp()))

    def log_scoring(self, deploy_id: str, n_rows: int) -> None:
        row = self.spark.createDataFrame([(deploy_id, n_rows)], "deploy_id string, n_rows long")
        self.append("scoring_log", row.coalesce(1).withColumn("created_at", F.current_timestamp()))

    def prediction_counts(self) -> DataFrame:
        """Scoring calls per deployment."""
        return self.read("scoring_log").groupBy("deploy_id").agg(F.count(F.lit(1)).alias("prediction_count"))
