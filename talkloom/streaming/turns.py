"""The sequence operators on an append-only stream of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.chat import CAREGIVERS

TRIPLES = "transcript_file string, index long, answered boolean, response_row_id long, follow_up_row_id long"
_STATE = "pending_id long, last_id long, last_speaker string, response_id long"


def stream_triples(turns: DataFrame, caregivers: list[str] | None = None) -> DataFrame:
    """Answered triples of a stream of turns (transcript_file, row_id, speaker_code), each emitted when its follow-up arrives.

    State per transcript is one open turn, so it does not grow with the stream. Turns of a
    transcript must arrive in order of row_id across batches; inside a batch they are sorted.
    """
    care = set(caregivers or CAREGIVERS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, last_id, last_speaker, response = state.get if state.exists else (None, None, None, None)
        out = []
        turns = pd.concat(list(batches)).sort_values("row_id")
        for row_id, speaker in zip(turns["row_id"], turns["speaker_code"]):
            if speaker == "CHI":
                if pending is not None:
                    out.append((key[0], pending, True, response, row_id))
                    pending = response = None
            elif last_speaker == "CHI" and speaker in care and last_id is not None and row_id == last_id + 1:
                pending, response = last_id, row_id
            last_id, last_speaker = int(row_id), speaker
        state.update((pending, last_id, last_speaker, response))
        yield pd.DataFrame(out, columns=["transcript_file", "index", "answered", "response_row_id", "follow_up_row_id"])

    return turns.groupBy("transcript_file").applyInPandasWithState(step, TRIPLES, _STATE, "append", "NoTimeout")


def stream_proportions(turns: DataFrame, time: str, flag: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window start, n, n_true of a flag per time window; rows later than `late` are dropped."""
    w = turns.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count(flag).alias("n"), F.count_if(F.col(flag)).alias("n_true"))
    return w.select(F.col("w.start").alias("window_start"), "n", "n_true")
