"""All registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.plans import crystal, data_quality, detector, kernels

QUERIES = {**data_quality.QUERIES, **detector.QUERIES, **crystal.QUERIES, **kernels.QUERIES}
ORACLE = {**data_quality.ORACLE, **detector.ORACLE, **crystal.ORACLE, **kernels.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["frame_peaks"](spark, sf_dir)
