"""Models written out and read back."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tabwright.operators.clean import Scale
from tabwright.operators.features import Encoder
from tabwright.operators.descent import DescentModel
from tabwright.operators.histogram_trees import Nodes, TreeModel
from tabwright.operators.learners import ConstantModel, LinearModel, NaiveBayesModel
from tabwright.operators.models import Fitted

CARD = "model_id string, algorithm string, features array<string>, model_data string, encoder string"
KINDS = {"baseline": ConstantModel, "naive_bayes": NaiveBayesModel}


def export(spark: SparkSession, fitted: Fitted, folder: str, encoder: Encoder | None = None) -> str:
    """Write a fitted learner: a one-row JSON table, and beside it the Spark pipeline or the nodes of its trees.

    With its encoder (categories, scales, target labels) it can later score raw rows.
    """
    model_id = uuid.uuid4().hex
    pipeline = isinstance(fitted.model, PipelineModel)
    if not pipeline and fitted.model is None:
        raise ValueError(f"{fitted.algorithm} keeps its training table and cannot be written as a model")
    data = None if pipeline else json.dumps({k: v for k, v in vars(fitted.model).items() if k != "nodes"})
    row = spark.createDataFrame(
        [(model_id, fitted.algorithm, fitted.features, data, None if encoder is None else json.dumps(asdict(encoder)))],
        CARD,
    )
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/card")
    if pipeline:
        fitted.model.write().overwrite().save(f"{folder}/pipeline")
    if isinstance(fitted.model, TreeModel):
        fitted.model.nodes.table(spark).write.mode("overwrite").parquet(f"{folder}/nodes")
    return model_id


def restore(spark: SparkSession, folder: str) -> tuple[str, Fitted]:
    """(new id, learner) of a written model; one without id, algorithm or content is refused."""
    card = spark.read.schema(CARD).json(f"{folder}/card").first()
    if card is None or not card.model_id or not card.algorithm:
        raise ValueError("not a written model")
    new_id = uuid.uuid4().hex
    if card.model_data is None:
        pipeline = PipelineModel.load(f"{folder}/pipeline")
        return new_id, Fitted(card.algorithm, list(card.features), pipeline.transform, [], pipeline)
    fields: dict[str, Any] = json.loads(card.model_data)
    if "rule" in fields:
        trees = TreeModel(Nodes.read(spark.read.parquet(f"{folder}/nodes"), card.features), **fields)
        return new_id, Fitted(card.algorithm, list(card.features), trees.predict, trees.importance(), trees)
    model = (DescentModel if fields.get("kind") == "descent" else KINDS.get(card.algorithm, LinearModel))(**fields)
    prediction = model.predict(list(card.features))
    return new_id, Fitted(
        card.algorithm, list(card.features), lambda df: df.withColumn("prediction", prediction), [], model
    )


def restore_encoder(spark: SparkSession, folder: str) -> Encoder | None:
    """The encoder written with a model, None if it was written without."""
    card = spark.read.schema(CARD).json(f"{folder}/card").first()
    if card is None or card.encoder is None:
        return None
    fields = json.loads(card.encoder)
    return Encoder(**{**fields, "scales": {name: Scale(**scale) for name, scale in fields["scales"].items()}})
