"""Batch hook for a caller's recogniser over a table of images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recognise(images: DataFrame, make_predict: Callable[[], Callable], batch_size: int = 64) -> DataFrame:
    """Apply ``predict(list of bytes) -> list of (text, score)`` to the images
    (crop_id, content, executed); rows gated off keep an empty text.

    ``make_predict`` runs once per task, so a model is loaded once per task. The
    filter comes before the Python step because Catalyst moves none through it.
    """
    todo = images.filter("executed").select("crop_id", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                answers = predict([bytes(content) for content in part["content"]])
                yield pd.DataFrame({
                    "crop_id": part["crop_id"].to_numpy(),
                    "txt": [text for text, _ in answers],
                    "score": [float(score) for _, score in answers],
                })

    read = todo.mapInPandas(run, "crop_id bigint, txt string, score double")
    digest = F.sha2("content", 256).alias("input_sha256")
    return images.select("crop_id", "executed", digest).join(read, "crop_id", "left").withColumn(
        "txt", F.coalesce("txt", F.lit(""))
    )
