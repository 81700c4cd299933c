"""A stream of questions against an index that does not change. Nothing is grouped by time,
so no watermark is needed; every micro-batch is a batch query, and batches are written under
their number, so a batch that runs again replaces its own output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import PROFILES, Config
from ..plans.pipeline import answer_questions


def answer_stream(questions: DataFrame, index: DataFrame, out: str, checkpoint: str, cfg: Config = PROFILES["module"], once: bool = False) -> StreamingQuery:
    def answer(batch: DataFrame, number: int) -> None:
        answer_questions(batch, index, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
