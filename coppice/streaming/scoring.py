"""Models on streams. Scoring keeps no state; a refresh goes on from the model that
is there with each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..model import Forest
from ..operators.predict import predict
from ..params import Params
from ..plans.train import train


def score_stream(forest: Forest, stream: DataFrame) -> DataFrame:
    """The stream with predictions, as a streaming DataFrame."""
    return predict(forest, stream)


def refresh_stream(stream: DataFrame, features: list[str], label: str, params: Params, done: Callable[[Forest, int], None], checkpoint: str, init: Forest | None = None) -> StreamingQuery:
    """Boost on with every micro-batch that has rows; ``done`` gets each model."""
    state = {"forest": init}

    def work(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            state["forest"], _ = train(batch, features, label, params, init=state["forest"])
            done(state["forest"], number)

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()
