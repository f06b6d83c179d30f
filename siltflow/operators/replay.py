"""Replies of a model, asked for again where they can't be used. What asks is passed in: a table of recorded replies, or a service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Fixed value: how often a reply is asked for.
ATTEMPTS = 2
#: What is wrong where there is no reply at all.
NO_REPLY = "no_reply"

#: From rows (id, attempt, why; why tells what was wrong with the attempt before, null at first) to (id, reply).
Ask = Callable[[DataFrame], DataFrame]


def recorded(replies: DataFrame) -> Ask:
    """Asks a table of replies (id, attempt, reply)."""
    return lambda rows: rows.select("id", "attempt").join(replies, ["id", "attempt"]).select("id", "reply")


def attempts(rows: DataFrame, ask: Ask, read: Callable[[Column], Column], most: int = ATTEMPTS) -> DataFrame:
    """(id, attempt, why, answer, error): a row for each attempt that was made for rows (id). read gives a struct with error, null where the reply
    can be used, as those of functions.replies do; a reply that isn't there or can't be read at all has the error NO_REPLY.

    Only rows whose attempt has an error are asked for again, with that error. Each attempt is asked for once and written, so that an action
    that runs again doesn't ask again.
    """
    left, out = rows.select("id").distinct().withColumn("why", F.lit(None).cast("string")), None
    for n in range(1, most + 1):
        # the attempt is a literal, not a written column, so that only this attempt's replies are read and shuffled
        asked = written(left).withColumn("attempt", F.lit(n))
        if n > 1 and asked.isEmpty():
            break
        answers = asked.join(ask(asked), "id", "left").withColumn("answer", read(F.col("reply")))
        got = written(answers.select("id", "attempt", "why", "answer", F.when(F.col("answer").isNull(), NO_REPLY).otherwise(F.col("answer.error")).alias("error")))
        out = got if out is None else out.unionByName(got)
        left = got.where("error is not null").select("id", F.col("error").alias("why"))
    return out


def settled(made: DataFrame) -> DataFrame:
    """(id, attempts, answer, error) of attempts(): the answer that could be used, or the last error."""
    last = made.groupBy("id").agg(F.max("attempt").cast("int").alias("attempts"), F.max_by(F.struct("answer", "error"), "attempt").alias("x"))
    return last.select("id", "attempts", F.when(F.col("x.error").isNull(), F.col("x.answer")).alias("answer"), F.col("x.error").alias("error"))
