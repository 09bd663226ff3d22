"""Replies sent from a stream: a failed one is a row that says so, and never loses its batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clipped
from ..operators.commits import Tables


def delivered(replies: DataFrame, send: Callable[[str, str], None]) -> DataFrame:
    """(id, to, text, failure) of replies (id, to, text): each is sent where its partition lies; failure is null if that went well, else
    the error, cut to 2,000 characters. A reply without receiver or text is not sent and fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            failures = []
            for to, text in zip(rows["to"], rows["text"], strict=True):
                try:
                    if not to or not text:
                        raise ValueError("no receiver or no text")
                    send(to, text)
                    failures.append(None)
                except Exception as failed:  # whatever goes wrong with one reply is that reply's outcome
                    failures.append(f"{type(failed).__name__}: {failed}")
            yield rows.assign(failure=pd.Series(failures, index=rows.index, dtype=object))

    plain = replies.select(F.col("id").cast("string"), F.col("to").cast("string"), F.col("text").cast("string"))
    sent = plain.mapInPandas(run, "id string, to string, text string, failure string")
    return sent.withColumn("failure", clipped(F.col("failure")))


def reply_batch(tables: Tables, send: Callable[[str, str], None], stream: str = "replies") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: sends a batch and commits its outcomes to the table `replies`. A batch that a commit holds is not
    sent again; one that was cut off between sending and committing is, so a reply is sent at least once."""

    def run(batch: DataFrame, number: int) -> None:
        tables.transact(lambda c: c.append("replies", delivered(batch, send)), stream, number, tries=1)

    return run
