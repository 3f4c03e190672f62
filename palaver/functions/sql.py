"""The functions that Spark lacks, under SQL names."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palaver.functions.editdist import edit_ops
from palaver.functions.evaltext import nfc
from palaver.functions.quality import _loop_cover


def register(spark: SparkSession) -> None:
    """Make them callable from ``spark.sql``: scalar functions, and a table function of terms."""
    spark.udf.register("palaver_nfc", nfc)
    spark.udf.register("palaver_edit_ops", edit_ops)
    spark.udf.register("palaver_loop_cover", _loop_cover)

    @F.udtf(returnType="term string")
    class Terms:
        """Devanagari runs and short Latin words of one text, one row each."""

        def eval(self, text: str):
            if text:
                for t in re.findall(r"[ऀ-ॿ]+", text):
                    yield (t,)
                for t in re.findall(r"\b[a-z]{2,6}\b", text.lower()):
                    yield (t,)

    spark.udtf.register("palaver_terms", Terms)


def apply_scorer(df, scorer, text: str = "text", alias: str = "score"):
    """Add the struct a model returns per text. ``scorer`` is any pandas function text to struct;
    load the model once per worker, in the iterator form of the function."""
    return df.withColumn(alias, scorer(F.col(text)))
