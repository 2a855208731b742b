"""Segmentation of categories: clustering of their vectors and naming of the clusters."""

from __future__ import annotations

import importlib

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions.columns import fill_template
from martlet.operators.aggregates import list_per
from martlet.operators.enrichment import EnrichFn, enrich
from martlet.operators.ordering import null_safe_join
from martlet.session import stable

CLUSTERS = 18
SEED = 42


def cluster(
    df: DataFrame, vector: str = "embeddings", k: int = CLUSTERS, seed: int = SEED, output: str = "cluster"
) -> tuple[KMeansModel, DataFrame]:
    """K-means by cosine distance; returns the model and ``df`` with the cluster of each row."""
    prepared = df.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(
        k=k, seed=seed, distanceMeasure="cosine", featuresCol="_features", predictionCol=output
    ).fit(prepared)
    return model, model.transform(prepared).drop("_features")


def members(df: DataFrame, group: str, value: str, plural: str, max_len: int = 1_000_000) -> DataFrame:
    """Sorted members of each group as a list and as text, in chunks of ``max_len`` (column ``part``)."""
    return list_per(df, group, value, plural, max_len).withColumn(f"{plural}_str", F.concat_ws(", ", plural))


def name_clusters(
    grouped: DataFrame, group: str, template: str, text: str, fn: EnrichFn, output: str, **options
) -> DataFrame:
    """A name per group from a prompt template with the placeholder ``{text column}``.

    Every chunk of a group's members is named; a group of several chunks is then named by the names of its chunks, in their
    order, so that it has one name that all its members had a say in.
    """
    part = F.col("part") if "part" in grouped.columns else F.lit(0)
    chunks = grouped.withColumns({"prompt": fill_template(template, **{text: text}), "_part": part})
    error = f"{output}_error"
    named = stable(enrich(chunks.select(F.struct(group, "_part").alias("_id"), "prompt"), "_id", "prompt", fn, output, **options))
    named = named.select(F.col(f"_id.{group}").alias(group), F.col("_id._part").alias("_part"), output, error)
    listed = F.array_sort(F.collect_list(F.struct("_part", output)))
    summed = named.groupBy(group).agg(F.count(F.lit(1)).alias("_parts"), F.first(output).alias(output), F.max(error).alias(error), F.transform(listed, lambda e: e[output]).alias("_names"))
    several = summed.filter("_parts > 1").select(group, F.concat_ws(", ", "_names").alias(text))
    again = enrich(several.select(group, fill_template(template, **{text: text}).alias("_prompt")), group, "_prompt", fn, output, **options)
    names = summed.filter("_parts = 1").select(group, output, error).unionByName(again.select(group, output, error))
    return null_safe_join(chunks.drop("_part"), names, [group], "left")


def segment_map(segments: DataFrame, plural: str, value: str, name: str) -> DataFrame:
    """Member to segment name, one row per member."""
    return segments.select(F.explode(plural).alias(value), name)


class SegmentTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that collects the members of each group and names the groups.

    ``namer`` is the import path ``module:function`` of the naming function, so that the stage can be saved.
    """

    groupCol = Param(Params._dummy(), "groupCol", "cluster column", TypeConverters.toString)
    valueCol = Param(Params._dummy(), "valueCol", "member column", TypeConverters.toString)
    pluralCol = Param(Params._dummy(), "pluralCol", "column for the list of members", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column for the group name", TypeConverters.toString)
    template = Param(Params._dummy(), "template", "prompt template", TypeConverters.toString)
    namer = Param(Params._dummy(), "namer", "import path of the naming function", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, groupCol=None, valueCol=None, pluralCol="members", outputCol="segment", template=None, namer=None):
        super().__init__()
        self._setDefault(pluralCol="members", outputCol="segment")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = {p.name: self.getOrDefault(p) for p in self.params}
        module, function = value["namer"].split(":")
        fn = getattr(importlib.import_module(module), function)
        grouped = members(dataset, value["groupCol"], value["valueCol"], value["pluralCol"])
        text = f"{value['pluralCol']}_str"
        return name_clusters(grouped, value["groupCol"], value["template"], text, fn, value["outputCol"])
