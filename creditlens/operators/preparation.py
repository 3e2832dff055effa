"""The fitted preparation as Spark ML stages: raw loan rows to feature vectors.

Each stage is a ``Transformer`` whose fitted numbers are a param, so a stage, and the
``PipelineModel`` of all of them, is saved and loaded by Spark ML's own writers and
readers. Stages are projections with literals: they work on streams as on tables, and
``transformSchema`` tells their columns, or what is missing, without any data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import features as fe
from .prefix import exact_quantiles
from .profile import engineer, numeric_columns, string_columns


class _Fitted(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage with fitted statistics, kept as JSON text in a param."""

    stats = Param(Params._dummy(), "stats", "fitted statistics as JSON text", TypeConverters.toString)

    def __init__(self, stats: dict | None = None):
        super().__init__()
        self._set(stats=json.dumps(stats if stats is not None else {}))

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.stats))

    def reads(self) -> list[str]:
        """Columns that the stage needs."""
        raise NotImplementedError

    def transformSchema(self, schema: StructType) -> StructType:
        missing = [c for c in self.reads() if c not in schema.names]
        if missing:
            raise ValueError(f"{type(self).__name__} needs the columns {missing}")
        return self._schema(schema)

    def _schema(self, schema: StructType) -> StructType:
        return schema

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        return self._apply(dataset)


class LoanEngineer(_Fitted):
    """Raw loan columns to engineered ones, with the income cap of the fitted table."""

    def reads(self):
        return [c for c in fe.PREP_FEATURES if c != "target"]

    def _schema(self, schema):
        double = {"annual_inc", "emp_length", "grade"}
        kept = [StructField(f.name, DoubleType()) if f.name in double else f for f in schema.fields if f.name not in ("earliest_cr_line", "pub_rec")]
        return StructType([*kept, StructField("credit_history_years", DoubleType()), StructField("has_derogatory", IntegerType())])

    def _apply(self, dataset):
        return engineer(dataset, cap=F.lit(self.fitted["income_cap"]).cast("double"))


class MedianModeImputer(_Fitted):
    """Fitted medians and modes in place of missing values."""

    def reads(self):
        return [c for kind in ("median", "mode") for c in self.fitted[kind]]

    def _schema(self, schema):
        known = {c for c, v in self.fitted["median"].items() if v is not None}
        return StructType([StructField(f.name, DoubleType()) if f.name in known else f for f in schema.fields])

    def _apply(self, dataset):
        return fe.apply_imputer(dataset, self.fitted)


class FirstDroppedOneHot(_Fitted):
    """A 0/1 column for each fitted level but the first; a level that was not met gets zeros only."""

    def reads(self):
        return list(self.fitted)

    def _schema(self, schema):
        made = lambda f: [StructField(f"{f.name}_{v}", IntegerType()) for v in self.fitted[f.name][1:]]
        return StructType([g for f in schema.fields for g in (made(f) if f.name in self.fitted else [f])])

    def _apply(self, dataset):
        return fe.apply_one_hot(dataset, self.fitted)


class PopulationScaler(_Fitted):
    """(x - mean) / population deviation of the fitted columns."""

    def reads(self):
        return list(self.fitted["mean"])

    def _schema(self, schema):
        return StructType([StructField(f.name, DoubleType()) if f.name in self.fitted["mean"] else f for f in schema.fields])

    def _apply(self, dataset):
        return fe.apply_scaler(dataset, self.fitted)


class FeatureVector(_Fitted):
    """The fitted features as a vector column, next to the other columns."""

    def reads(self):
        return self.fitted["features"]

    def _schema(self, schema):
        from pyspark.ml.linalg import VectorUDT

        return StructType([*[f for f in schema.fields if f.name not in self.reads()], StructField("features", VectorUDT())])

    def _apply(self, dataset):
        own = self.reads()
        plain = dataset.select(*[F.col(f"`{c}`") for c in dataset.columns if c not in own], *[F.col(f"`{c}`").cast("double").alias(f"_f{i}") for i, c in enumerate(own)])
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(own))], outputCol="features", handleInvalid="keep").transform(plain).drop(*[f"_f{i}" for i in range(len(own))])


def fit_preparation(labelled: DataFrame, id_col: str = "id", target: str = "target", test_fraction: float = 0.2,
                    leave_out: Sequence[str] = ()) -> PipelineModel:
    """The preparation fitted on a labelled table: cap, medians, modes and levels on all its
    rows, scaling on the training side of ``stratified_split``; ``leave_out`` names features
    that the vector does not take. ``transform`` takes raw rows, with or without a target."""
    cap = exact_quantiles(labelled, "annual_inc", [0.99]).first()
    steps = [LoanEngineer({"income_cap": cap["q_0"] if cap else None})]
    base = steps[0].transform(labelled.select(id_col, *[c for c in fe.PREP_FEATURES if c in labelled.columns]))
    others = [id_col, target]
    numbers, texts = numeric_columns(base, others), string_columns(base, others)
    steps.append(MedianModeImputer(fe.fit_imputer(base, numbers, texts)))
    imputed = steps[1].transform(base)
    steps.append(FirstDroppedOneHot(fe.fit_levels(imputed, texts)))
    encoded = steps[2].transform(imputed)
    names = [c for c in encoded.columns if c not in others]
    train = fe.stratified_split(encoded, target, test_fraction, id_col).filter(~F.col("is_test"))
    steps.append(PopulationScaler(fe.fit_scaler(train, names)))
    steps.append(FeatureVector({"features": [c for c in names if c not in leave_out]}))
    return PipelineModel(steps)
