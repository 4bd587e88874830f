"""Row scoring of a stream of stories: each row stands alone, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from storyscale.operators import objective


def score_stream(stories: DataFrame) -> DataFrame:
    """Row metrics of a streaming (or batch) relation of stories."""
    return objective.objective_rows(stories)
