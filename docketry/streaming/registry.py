"""Registry answers with a lifetime, met by a stream of citations.

An answer of the registry counts for citations of its key for so many seconds of event
time. Events may come late by the watermark's delay, so a citation waits in the state until
the watermark has passed it; a timer of the key then answers it with the newest answer
that is not older than the lifetime. State is what a lifetime and a delay hold: answers
that no citation can meet any more are dropped. A key's citations are grouped by spans of
one lifetime; an answer goes to its own span and the next, as no later one can meet it. A
busy key's citations are further dealt to ``deals`` groups, which all get its answers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, event_id long, cited timestamp, answer string, answered timestamp"
STATE = "answers array<struct<at:long,id:long,answer:string>>, waiting array<struct<at:long,id:long>>"


def answered(events: DataFrame, lifetime: int = 3_600, late: str = "10 minutes", deals: int = 4) -> DataFrame:
    """One row per citation that the watermark has passed: key, event_id, cited, answer, answered.

    ``events`` is a stream of (key, event_id, ts, answer): a null ``answer`` marks a
    citation. Of answers up to the citation's time the newest counts, of equal times the
    larger event id; ``answer`` stays null if it is missing or as old as ``lifetime``
    seconds or older. A null key is a key of its own.
    """
    whole = F.sequence(F.lit(0), F.lit(deals - 1))
    own = F.array(F.pmod(F.xxhash64("event_id"), F.lit(deals)).cast("int"))
    length = lifetime * 1_000_000
    span = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(length)).cast("long")
    dealt = events.withWatermark("ts", late).select(
        F.col("key").cast("string").alias("key"), F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit("")).alias("held"), "event_id", "ts", "answer",
        F.explode(F.when(F.col("answer").isNull(), own).otherwise(whole)).alias("deal"),
        F.when(F.col("answer").isNull(), F.array(span)).otherwise(F.array(span, span + 1)).alias("spans"),
    ).select("key", "held", "event_id", "ts", "answer", "deal", F.explode("spans").alias("span"))

    def meet(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answers, waiting = ([tuple(x) for x in part] for part in state.get) if state.exists else ([], [])
        for frame in frames:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            for t, number, answer in zip(at, frame["event_id"], frame["answer"]):
                if answer is None or answer is pd.NA or answer != answer:
                    waiting.append((int(t), int(number)))
                else:
                    answers.append((int(t), int(number), answer))
        passed = state.getCurrentWatermarkMs() * 1000
        answers.sort()
        times = [a[0] for a in answers]
        out, left = [], []
        for t, number in sorted(waiting):
            if t >= passed:
                left.append((t, number))
                continue
            place = bisect_right(times, t)
            met = answers[place - 1] if place else None
            good = met is not None and t - met[0] < length
            out.append((number, t, met[2] if good else None, met[0] if good else None))
        # Later citations are no earlier than the watermark: of the answers before it only the newest can count.
        old = [a for a in answers if a[0] < passed][-1:]
        answers = [a for a in old if passed - a[0] < length] + [a for a in answers if a[0] >= passed]
        # Nor do they come to a span that has ended.
        end = (int(group[2]) + 1) * length if group[2] is not None and group[2] == group[2] else passed
        answers = answers if passed < end else []
        if left or answers:
            state.update((answers, left))
            after = left[0][0] if left else min(answers[0][0] + length, end)
            state.setTimeoutTimestamp(max(after // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            key = group[0][1:] if group[0] else None
            made = pd.DataFrame(out, columns=["event_id", "cited", "answer", "answered"])
            made.insert(0, "key", key)
            for c in ("cited", "answered"):
                made[c] = pd.to_datetime(made[c], unit="us")
            yield made

    return dealt.groupBy("held", "deal", "span").applyInPandasWithState(meet, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
