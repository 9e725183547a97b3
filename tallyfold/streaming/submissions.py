"""Submissions as a stream; lateness is a rule of the round, not of the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.submissions import decide_submissions


def decide_stream(stream: DataFrame, rounds: DataFrame, **limits) -> DataFrame:
    """The gates of ``decide_submissions`` as a stateless stream-static join."""
    return decide_submissions(stream, rounds, **limits)
