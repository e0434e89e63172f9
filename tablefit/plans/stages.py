"""Plans as pipeline stages: a fitted plan, a feature assembler and a model in one PipelineModel that can be
saved and loaded whole."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from tablefit.operators.clean import fill_values
from tablefit.operators.facts import Facts
from tablefit.plans.plan import Fitted, build_plan, fit_plan
from tablefit.sources.tables import column_kinds, normalise


class _PlanParams(Params):
    target = Param(Params._dummy(), "target", "name of the target column", typeConverter=TypeConverters.toString)
    rules = Param(Params._dummy(), "rules", "rule set of the plan: simple or strict", typeConverter=TypeConverters.toString)


class PlanModel(Transformer, _PlanParams, MLReadable, MLWritable):
    """A fitted plan as a stage. Columns that the table lacks are passed over, as in ``Fitted.apply``, so
    a table without the target can be prepared for prediction."""

    def __init__(self, fitted: Fitted | None = None):
        super().__init__()
        self._setDefault(rules="simple")
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.apply(normalise(dataset))

    def write(self) -> MLWriter:
        return _PlanWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PlanReader(cls)


class _PlanWriter(MLWriter):
    def __init__(self, stage: PlanModel):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.fitted.save(f"{path}/fitted")


class _PlanReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PlanModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls(Fitted.load(self.sparkSession, f"{path}/fitted"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class PlanEstimator(Estimator, _PlanParams, DefaultParamsReadable, DefaultParamsWritable):
    """Decides a plan from the facts of a table and fits it. Gaps that the plan leaves are filled by the
    median (numbers) or ``Unknown`` (text) as the last step, with constants of the fitted table."""

    @keyword_only
    def __init__(self, *, target: str | None = None, rules: str = "simple"):
        super().__init__()
        self._setDefault(rules="simple")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PlanModel:
        f = Facts(dataset)
        target = self.getOrDefault("target") if self.isSet("target") else None
        fitted = fit_plan(f, build_plan(f, target, self.getOrDefault("rules")))
        g = Facts(fitted.apply(f.df))
        rest = {n: "median" if g.kinds[n] == "numeric" else "constant" for n in g.columns if n != target and g.kinds[n] in ("numeric", "string") and g.scan()[n]["missing"]}
        for n, v in (fill_values(g, rest) if rest else {}).items():
            if v is not None:
                number = g.kinds[n] == "numeric"
                fitted.steps.append((n, "impute", rest[n], {"value": float(v) if number else v, "number": number, "type": g.types[n], "cells": g.scan()[n]["missing"]}))
        return self._copyValues(PlanModel(fitted))


def fit_pipeline(df: DataFrame, target: str, model: Estimator, rules: str = "simple", keep: list[str] | None = None) -> PipelineModel:
    """Plan, assembler and model fitted on a table, as one PipelineModel. ``keep`` are columns (keys) that
    pass through unprepared and are no features."""
    keep = keep or []
    plan = PlanEstimator(target=target, rules=rules).fit(df.drop(*keep))
    ready = plan.transform(df)
    kinds = column_kinds(ready)
    gather = VectorAssembler(inputCols=[n for n in ready.columns if n not in (target, *keep) and kinds[n] == "numeric"], outputCol="features", handleInvalid="keep")
    rows = gather.transform(ready).where(ready[target].isNotNull())
    return PipelineModel(stages=[plan, gather, model.fit(rows)])


def load_pipeline(spark: SparkSession, path: str) -> PipelineModel:
    """A saved pipeline; its stages read through ``spark``."""
    return PipelineModel.read().session(spark).load(path)
