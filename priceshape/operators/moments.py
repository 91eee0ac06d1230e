"""Weighted mean, dispersion and shape moments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from priceshape.operators.samples import Sample, expressions, join_facts, named


@named
def moments(sample: Sample, fisher: bool = True) -> DataFrame:
    """keys + mean, variance, std, skewness, kurtosis, ess; one row per group.

    The facts of the sample have the moments already: Spark's own aggregates with unit weights, merged
    centred sums with others. Only groups of arrays or structs with weights take a pass of their own. A group whose positive-weight values are all equal has zero variance.
    """
    facts = sample.facts
    if "var" not in facts.columns:
        centre = facts.selectExpr(*sample.keys, "swx / sw AS _mean")
        centred = (
            sample.attach(sample.rows, centre)
            .selectExpr(*sample.keys, "_w", "_x - _mean AS _d")
            .groupBy(*sample.keys)
            .agg(
                *expressions(
                    {
                        "s2": "sum(_w * _d * _d)",
                        "s3": "sum(_w * _d * _d * _d)",
                        "s4": "sum(_w * _d * _d * _d * _d)",
                    }
                )
            )
        )
        facts = join_facts(centred, facts, sample.keys).selectExpr(
            "*",
            "s2 / sw AS var",
            "try_divide(s3 / sw, pow(s2 / sw, 1.5)) AS skew",
            "try_divide(s4 / sw, pow(s2 / sw, 2)) - 3 AS kurt",
        )
    excess = "kurt" if fisher else "kurt + 3"

    def or_zero(measure: str, name: str) -> str:
        return f"if(positive_lo < positive_hi AND var > 0, {measure}, 0D) AS {name}"

    return facts.selectExpr(
        *sample.keys,
        "swx / sw AS mean",
        or_zero("var", "variance"),
        or_zero("sqrt(var)", "std"),
        or_zero("skew", "skewness"),
        or_zero(excess, "kurtosis"),
        "sw * sw / sw2 AS ess",
    )


@named
def normalized_weights(sample: Sample) -> DataFrame:
    """Rows with ``weight`` scaled to sum to one within the group."""
    totals = sample.facts.select(*sample.keys, "sw")
    joined = sample.attach(sample.rows, totals)
    return joined.selectExpr("*", "_w / sw AS weight").drop("sw")
