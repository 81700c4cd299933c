"""Rows and seconds of a step, taken while the job that computes it runs."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("parchmill")


class Measure:
    """``rows`` waits for the job; ``seconds`` run from the making of the measure."""

    def __init__(self, name: str):
        self.name, self.began, self._seen = name, time.time(), Observation(name)

    @property
    def rows(self) -> int:
        n = self._seen.get["rows"]
        log.info("%s: %d rows after %.2f s", self.name, n, self.seconds)
        return n

    @property
    def seconds(self) -> float:
        return time.time() - self.began


def measured(df: DataFrame, name: str) -> tuple[DataFrame, Measure]:
    """The same rows, counted on their way without a job of their own."""
    m = Measure(name)
    return df.observe(m._seen, F.count(F.lit(1)).alias("rows")), m
