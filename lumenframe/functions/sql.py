"""Functions for users of SQL: ``register(spark)`` and then ``SELECT frame_id(filename, event) …``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.lattice import cell_of, reduce_basis

#: SQL functions are expressions to the optimizer: they are inlined and stay in the JVM.
EXPRESSIONS = {
    "frame_id(filename STRING, event BIGINT) RETURNS STRING": "substr(sha1(concat(filename, '//', cast(event AS STRING))), 1, 16)",
    "q_of(x DOUBLE, y DOUBLE, clen DOUBLE, wavelength DOUBLE) RETURNS STRUCT<qx DOUBLE, qy DOUBLE, qz DOUBLE>": "named_struct("
    "'qx', x / sqrt(x * x + y * y + clen * clen) / wavelength, 'qy', y / sqrt(x * x + y * y + clen * clen) / wavelength, 'qz', (clen / sqrt(x * x + y * y + clen * clen) - 1) / wavelength)",
    "excitation(qx DOUBLE, qy DOUBLE, qz DOUBLE, wavelength DOUBLE) RETURNS DOUBLE": "sqrt(pow(wavelength * qx, 2) + pow(wavelength * qy, 2) + pow(wavelength * qz + 1, 2)) - 1",
    "z_score(adu DOUBLE, mean DOUBLE, var DOUBLE) RETURNS DOUBLE": "(adu - mean) / sqrt(greatest(var, 1e-12D))",
    "log_bayes_factor(z DOUBLE, kappa DOUBLE) RETURNS DOUBLE": "CASE WHEN z > 0 THEN -ln(kappa) + 0.5D * (1 - 1 / (kappa * kappa)) * z * z ELSE 0D END",
    "poisson_sf(k INT, mean DOUBLE) RETURNS DOUBLE": "CASE WHEN k IS NULL OR mean IS NULL THEN NULL WHEN k <= 0 THEN 1D WHEN mean <= 0 THEN 0D ELSE greatest(0D, 1D - aggregate(sequence(0, k - 1), named_struct('t', exp(-mean), 's', 0D), "
    "(a, i) -> named_struct('t', a.t * mean / (i + 1), 's', a.s + a.t), a -> a.s)) END",
    "cell_volume(a DOUBLE, b DOUBLE, c DOUBLE, alpha DOUBLE, beta DOUBLE, gamma DOUBLE) RETURNS DOUBLE": "a * b * c * sqrt(greatest(0D, 1 - pow(cos(radians(alpha)), 2) - pow(cos(radians(beta)), 2) - pow(cos(radians(gamma)), 2)"
    " + 2 * cos(radians(alpha)) * cos(radians(beta)) * cos(radians(gamma))))",
}


class PredictHkl:
    """``predict_hkl(a, q_max, wavelength, tolerance)``: the index triples of a matrix (nine numbers, row by row)
    near the Ewald sphere. A NULL or incomplete matrix gives no rows."""

    def eval(self, a, q_max: float, wavelength: float, tolerance: float) -> Iterator[tuple[int, int, int]]:
        from lumenframe.operators.reflections import _BITS, _HALF, shell_triples

        m = np.asarray([np.nan if x is None else x for x in a], float) if a is not None else np.empty(0)
        if m.size != 9 or not np.isfinite(m).all():
            return
        for p in shell_triples(m.reshape(3, 3), q_max, wavelength, tolerance).tolist():
            yield (p >> 2 * _BITS) - _HALF, (p >> _BITS & 2 * _HALF - 1) - _HALF, (p & 2 * _HALF - 1) - _HALF


def register(spark: SparkSession) -> list[str]:
    """Register all functions with a session; returns their names."""
    names = []
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])

    @F.pandas_udf("struct<a double, b double, c double, alpha double, beta double, gamma double>")
    def reduce_cell(m: pd.Series) -> pd.DataFrame:
        got = []
        for x in m:
            c = cell_of(reduce_basis(np.asarray(x, float).reshape(3, 3))) if x is not None and len(x) == 9 else (np.nan,) * 6
            got.append((*c[:3], *[math.degrees(v) for v in c[3:]]))
        return pd.DataFrame(got, columns=["a", "b", "c", "alpha", "beta", "gamma"])

    spark.udf.register("reduce_cell", reduce_cell)
    spark.udtf.register("predict_hkl", F.udtf(PredictHkl, returnType="h int, k int, l int"))
    return [*names, "reduce_cell", "predict_hkl"]
