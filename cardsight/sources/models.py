"""Fitted pipeline persistence (A3, A4) and pipelines saved under other names."""

from __future__ import annotations

import json
import re

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.pipeline import PipelineSharedReadWrite
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from ..operators import features

# Stages of our own that a pipeline may hold under another module path, by class name.
OWN_STAGES = {c.__name__: c for c in (features.LogTransformer, features.PairwiseTransformer, features.BoxCoxTransformer)}


def save_model(model: PipelineModel, path: str, overwrite: bool = True) -> str:
    """Write a fitted pipeline (metadata JSON + Parquet per stage); overwrite by default."""
    w = model.write()
    if overwrite:
        w = w.overwrite()
    w.save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Read a fitted pipeline; custom stages are found through their stored class path."""
    return PipelineModel.load(path)


def stage_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()[0])


def _camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m[1].upper(), name)


def _own_stage(metadata: dict, cls: type, params: dict[str, str]) -> Transformer:
    """A stage of ours with the stored parameters under our names. Output names that our stage derives from its inputs
    must be the stored ones, in any order of storage; any other parameter unknown to us is an error."""
    stage = cls()
    stage._resetUid(metadata["uid"])
    names = []
    for source in ("defaultParamMap", "paramMap"):
        for stored, value in metadata.get(source, {}).items():
            name = params.get(stored, _camel(stored))
            if value is None:
                continue
            if stage.hasParam(name):
                stage._set(**{name: value})
            elif name == "outputCols":
                names = value
            else:
                raise ValueError(f"{metadata['class']} has a parameter {stored} that {cls.__name__} does not know")
    if names and list(names) != list(stage.getOutputCols()):
        raise ValueError(f"{metadata['class']} writes {names[:3]}... where {cls.__name__} writes {stage.getOutputCols()[:3]}...")
    return stage


def load_foreign(spark: SparkSession, path: str, classes: dict[str, type] | None = None,
                 params: dict[str, str] | None = None) -> PipelineModel:
    """A fitted pipeline whose custom stages were saved from another module, under other class paths and
    parameter names (F13).

    ``classes`` maps stored class names - whole paths or their last part - to ours (default
    :data:`OWN_STAGES`), ``params`` stored parameter names to ours (default: snake case read as camel case).
    Spark's own stages load as they are; a custom class that is not mapped is an error."""
    classes, path = classes or OWN_STAGES, path.rstrip("/")
    metadata = stage_metadata(spark, path)
    uids, stages = metadata["paramMap"]["stageUids"], []
    for i, uid in enumerate(uids):
        at = PipelineSharedReadWrite.getStagePath(uid, i, len(uids), f"{path}/stages")
        stored = stage_metadata(spark, at)
        name = stored["class"]
        cls = classes.get(name) or classes.get(name.rsplit(".", 1)[-1])
        if cls is not None:
            stages.append(_own_stage(stored, cls, params or {}))
        elif name.startswith(("org.apache.spark.", "pyspark.")):
            stages.append(DefaultParamsReader.loadParamsInstance(at, spark))
        else:
            raise ValueError(f"no stage is known for {name}")
    model = PipelineModel(stages)
    model._resetUid(metadata["uid"])
    return model
