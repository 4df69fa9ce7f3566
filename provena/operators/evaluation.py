"""Scoring a detector against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def detector_metrics(cases: DataFrame) -> DataFrame:
    """Overall and per class, from (label, expect_fail, predicted) in one aggregation.

    Unknown on a bad case counts as detected. Unknown on a clean case counts in none of
    the four cells and is reported apart.
    """
    gold, said = F.col("expect_fail"), F.col("predicted")
    flagged = said.isin("fail", "unknown")
    counted = cases.groupingSets([[], ["label"]], "label").agg(
        F.when(F.grouping("label") == 1, "overall").otherwise(F.col("label")).alias("class"),
        F.count("*").alias("n"),
        F.count_if(gold == flagged).alias("detected"),
        F.count_if(gold & flagged).alias("tp"),
        F.count_if(~gold & (said == "fail")).alias("fp"),
        F.count_if(gold & ~flagged).alias("fn"),
        F.count_if(~gold & (said == "pass")).alias("tn"),
        F.count_if(~gold & (said == "unknown")).alias("unknown_clean"),
        F.count_if(gold & (said == "unknown")).alias("unknown_bad"),
    )
    return counted.drop("label").select(
        "*",
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _share(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )
