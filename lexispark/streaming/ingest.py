"""An extension for arriving records: the first record of each text within a watermark goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import casefold


def first_records(stream: DataFrame, time_col: str = "ts", text_col: str = "text", delay: str = "1 day") -> DataFrame:
    keyed = stream.withColumn("text_sha256", F.sha2(casefold(F.coalesce(F.col(text_col), F.lit(""))), 256))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["text_sha256"])
