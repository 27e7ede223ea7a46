"""The library's functions under SQL names, for queries written as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from .text import character_loss, nfkc, text_similarity_udf


@pandas_udf("double")
def safe_mean(v: pd.Series) -> float:
    """Mean of the numbers of a group, 0 if there is none."""
    v = pd.to_numeric(v, errors="coerce").dropna()
    return float(v.mean()) if len(v) else 0.0


def register(spark: SparkSession) -> list[str]:
    """Register the Arrow functions, a grouped aggregate among them; returns their names."""
    functions = {"pl_nfkc": nfkc, "pl_similarity": text_similarity_udf, "pl_character_loss": character_loss, "pl_safe_mean": safe_mean}
    for name, f in functions.items():
        spark.udf.register(name, f)
    return list(functions)
