"""A model with its manifest: what it was trained on, and the check of every table it is to score."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from renewlens.operators.model import feature_names, load_model, save_model
from renewlens.plans.scoring import predictions

VERSION = 1


@dataclass(frozen=True)
class Manifest:
    """Features in their order with their types, training parameters and decision threshold."""

    features: list[list[str]]
    params: dict
    threshold: float
    version: int = VERSION

    def problems(self, df: DataFrame) -> list[str]:
        """What keeps a table from being scored: features it lacks or has under another type."""
        types = dict(df.dtypes)
        return [
            f"{name} is {'missing' if name not in types else types[name] + ', not ' + kind}"
            for name, kind in self.features if types.get(name) != kind
        ]


def deploy(model: PipelineModel, trained_on: DataFrame, params: Mapping, threshold: float, path: str) -> Manifest:
    """Save the model and its manifest under ``path``, over what is there."""
    types = dict(trained_on.dtypes)
    scalar = {k: v for k, v in params.items() if isinstance(v, (int, float, str, bool))}
    manifest = Manifest([[c, types[c]] for c in feature_names(model)], scalar, float(threshold))
    save_model(model, f"{path}/model")
    row = trained_on.sparkSession.createDataFrame([(json.dumps(asdict(manifest)),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    data = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if data.get("version") != VERSION:
        raise ValueError(f"manifest of version {data.get('version')}, this code reads {VERSION}")
    return Manifest(**data)


def score_deployed(df: DataFrame, path: str) -> DataFrame:
    """Prediction table of a cohort, labelled or not, from a model saved in whatever session.

    Refused are a table without the features of the manifest or with other types of them, and a model
    whose inputs are not those of the manifest. Further columns don't matter.
    """
    manifest, model = read_manifest(df.sparkSession, path), load_model(f"{path}/model")
    if feature_names(model) != [name for name, _ in manifest.features]:
        raise ValueError("the model's inputs are not the features of its manifest")
    problems = manifest.problems(df)
    if problems:
        raise ValueError("the table does not fit the model: " + "; ".join(problems))
    return predictions(df, model, manifest.threshold)
