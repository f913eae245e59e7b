"""Stages that treat each document by itself, over a streaming DataFrame.

Collections have no streaming operators of their own; these stages are row by row, so the same plan runs incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.pipeline import STATELESS, Frame, parse
from ..plans.pipeline import STAGES as COMPILED


def stream_pipeline(df: DataFrame, pipeline: list[dict]) -> DataFrame:
    frame = Frame(df)
    for name, x in parse(pipeline):
        if name not in STATELESS:
            raise ValueError(f"{name} needs more than one document at a time")
        frame = COMPILED[name](frame, x, False)
    return frame.df
