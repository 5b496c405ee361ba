"""Answers assembled from token events, and progress events."""

from __future__ import annotations

from collections.abc import Container, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlight.ordering import join_segments
from loomlight.schemas import PROGRESS, SCOPE_EXPANSION

TOKENS_PER_SEGMENT = 1000
STATE_HOURS = 24
# State keys that messages are dealt to; fixed for the life of a stream.
MESSAGE_BUCKETS = 512
# Events that carry something other than text, and the two
# notices a widened search gives.
CONTROL_EVENTS = ["citations", "visuals", "progress", "scope_expansion", "error", "done", "retry"]
EXPANSION_NOTICES = [
    ("WARN", "No sufficient evidence found"),
    ("INFO", "Expanding to entire knowledge base"),
]


def message_status(events: DataFrame) -> DataFrame:
    """One row per message: its bounds, status and last citations and visuals.

    ``events`` has message_id, seq, event and data. Only sums, minima and
    maxima are taken, so a message of any length combines on the map side.
    """
    kind = F.col("event")

    def seq_of(name: str):
        return F.when(kind == name, F.col("seq"))

    def last(name: str):
        return F.max_by(F.when(kind == name, F.col("data")), seq_of(name))

    return (
        events.groupBy("message_id")
        .agg(
            F.min(seq_of("done")).alias("done_at"),
            F.min(seq_of("error")).alias("error_at"),
            last("error").alias("error"),
            last("citations").alias("citations_json"),
            last("visuals").alias("visuals_json"),
        )
        .withColumn(
            "status",
            F.when(F.col("error_at").isNotNull(), "FAILED")
            .when(F.col("done_at").isNotNull(), "COMPLETED")
            .otherwise("PROCESSING"),
        )
    )


def assembled_text(events: DataFrame) -> DataFrame:
    """(message_id, segment_no, text): tokens after the last retry and before ``done``.

    A segment covers 1,000 sequence numbers; the answer is the segments in
    order. Retries after ``done`` do not count.
    """
    ends = events.groupBy("message_id").agg(
        F.min(F.when(F.col("event") == "done", F.col("seq"))).alias("done_at")
    )
    open_events = events.join(ends, "message_id").filter(
        F.col("done_at").isNull() | (F.col("seq") < F.col("done_at"))
    )
    retries = (
        open_events.filter("event = 'retry'").groupBy("message_id").agg(F.max("seq").alias("from"))
    )
    tokens = (
        open_events.filter(~F.col("event").isin(CONTROL_EVENTS))
        .join(retries, "message_id", "left")
        .filter(F.col("from").isNull() | (F.col("seq") > F.col("from")))
    )
    return join_segments(tokens, ["message_id"], "seq", "data", size=TOKENS_PER_SEGMENT)


def _assembler(first: int, ttl_ms: int | None, wait_ms: int) -> StatefulProcessor:
    """Built here so that it travels with its code to Spark's stream runner."""

    def joined(events: Iterable[tuple[int, str, str]], done: int) -> tuple[str, bool]:
        """(text, whether it failed) of the events before ``done``, each number once."""
        parts, failing, seen = [], False, None
        for seq, event, data in sorted(events, key=lambda e: e[0]):
            if seq == seen or seq >= done:
                continue
            seen = seq
            if event == "retry":
                parts = []
            elif event == "error":
                failing = True
            elif event not in CONTROL_EVENTS:
                parts.append(data)
        return "".join(parts), failing

    def with_numbers(ranges: list[tuple[int, int]], numbers: Iterable[int]) -> list[tuple[int, int]]:
        """Inclusive ranges of numbers with some more, touching ones joined."""
        out: list[tuple[int, int]] = []
        for low, high in sorted([*ranges, *((n, n) for n in numbers)]):
            if out and low <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], high))
            else:
                out.append((low, high))
        return out

    class Assembler(StatefulProcessor):
        """Events of the messages of a bucket; a message's are held until none is missing up to its end."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # One element a batch, or what is left of some.
            self.pieces = handle.getListState(
                "pieces", "messages array<string>, seqs array<bigint>, events array<string>, data array<string>"
            )
            # One element a waiting message: ranges of the numbers that came, the number of the end, when it
            # was last heard of and until when it may wait.
            self.waiting = handle.getListState(
                "waiting", "message string, low array<bigint>, high array<bigint>, done bigint, at bigint, due bigint"
            )
            # What arrives for a finished answer is ignored as long as these marks last. One element a batch.
            self.given = handle.getListState("given", "messages array<string>", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True)
            now = 0 if ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
            given = {m for (messages,) in (self.given.get() if self.given.exists() else ()) for m in messages}
            new: dict[str | None, list[tuple[int, str, str]]] = {}
            for message, seq, event, data in batch[["message_id", "seq", "event", "data"]].itertuples(index=False):
                if message not in given:
                    new.setdefault(message, []).append((int(seq), event, data))
            if not new:
                return
            waiting, ready, begun = self.waits(), {}, False
            for message, events in new.items():
                low, high, done, _, due = waiting.pop(message, ((), (), None, None, None))
                ranges = with_numbers(list(zip(low, high, strict=True)), (n for n, _, _ in events))
                ends = [n for n, e, _ in events if e == "done"]
                done = min([*ends, *([] if done is None else [done])], default=None)
                if done is not None and any(a <= first and done <= b for a, b in ranges):
                    ready[message] = done
                    begun |= bool(low)
                else:
                    due = now + wait_ms if due is None and done is not None else due
                    waiting[message] = ([a for a, _ in ranges], [b for _, b in ranges], done, now, due)
            held = self.taken(ready) if begun else {}
            kept = [(m, *event) for m, events in new.items() if m not in ready for event in events]
            if kept:
                self.pieces.appendValue(tuple(map(list, zip(*kept, strict=True))))
            texts = {m: joined([*held.get(m, ()), *new[m]], done) for m, done in ready.items()}
            self.keep(waiting)
            yield from self.finished({m: (text, "FAILED" if failing else "COMPLETED") for m, (text, failing) in texts.items()})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, waiting = timerValues.getCurrentProcessingTimeInMs(), self.waits()
            over = {m: done for m, (_, _, done, _, due) in waiting.items() if due is not None and due <= now}
            left = {m for m, (_, _, _, at, _) in waiting.items() if at + ttl_ms <= now}
            if not over and not left:
                return
            held = self.taken({*over, *left})
            self.keep({m: wait for m, wait in waiting.items() if m not in over and m not in left})
            yield from self.finished({m: (joined(held.get(m, ()), done)[0], "INCOMPLETE") for m, done in over.items()})

        def waits(self) -> dict[str | None, tuple]:
            found = self.waiting.get() if self.waiting.exists() else ()
            return {message: wait for message, *wait in found}

        def keep(self, waiting: dict[str | None, tuple]) -> None:
            if waiting:
                self.waiting.put([(message, *wait) for message, wait in waiting.items()])
                if ttl_ms is not None:
                    moments = (at + ttl_ms if due is None else due for _, _, _, at, due in waiting.values())
                    self.handle.registerTimer(min(moments))
            else:
                self.waiting.clear()

        def taken(self, messages: Container[str | None]) -> dict[str | None, list[tuple[int, str, str]]]:
            """Events of some messages, which leave the state."""
            found, rest = {}, []
            for piece in self.pieces.get() if self.pieces.exists() else ():
                for message, *event in zip(*piece, strict=True):
                    if message in messages:
                        found.setdefault(message, []).append(tuple(event))
                    else:
                        rest.append((message, *event))
            if rest:
                self.pieces.put([tuple(map(list, zip(*rest, strict=True)))])
            else:
                self.pieces.clear()
            return found

        def finished(self, answers: dict[str | None, tuple[str, str]]) -> Iterator[pd.DataFrame]:
            if answers:
                self.given.appendValue((list(answers),))
                text, status = zip(*answers.values(), strict=True)
                yield pd.DataFrame({"message_id": list(answers), "text": text, "status": status})

        def close(self) -> None:
            pass

    return Assembler()


def assemble_stream(events: DataFrame, expire: bool = False, first: int = 1, wait: str = "10 minutes") -> DataFrame:
    """Finished answers of a token stream: message_id, text and status.

    Events of a message may come in any order and batch, and more than once.
    Their numbers run from ``first`` without a gap, so the end is known to be
    the end only when every number up to it has come; until then the answer
    waits. Its text then leaves the state; a mark stays. With ``expire`` the wait
    for missing numbers ends after ``wait`` by the clock, and what has come is
    given as INCOMPLETE; marks and abandoned answers leave after a day; such a
    stream runs on. Messages share ``MESSAGE_BUCKETS`` state keys, so a batch asks
    the state store a few times per bucket. Needs the RocksDB state store.
    """
    # Ids go as texts: beside missing ones, whole numbers would not stay whole.
    dealt = events.select(
        F.col("message_id").cast("string").alias("message_id"), "seq", "event", "data",
        F.pmod(F.xxhash64("message_id"), F.lit(MESSAGE_BUCKETS)).alias("_bucket"),
    )
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    answers = dealt.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_assembler(first, STATE_HOURS * 3_600_000 if expire else None, wait_ms),
        outputStructType="message_id string, text string, status string",
        outputMode="append",
        timeMode="ProcessingTime" if expire else "None",
    )
    return answers.withColumn("message_id", F.col("message_id").cast("bigint"))


def progress_log(events: DataFrame) -> DataFrame:
    """Progress notices per message: (message_id, seq, part, stage, status, message, iteration).

    A widened search shows as a warning and a notice.
    """
    parsed = events.filter("event = 'progress'").withColumn("p", F.from_json("data", PROGRESS))
    plain = parsed.filter("p.stage is not null").select(
        "message_id",
        "seq",
        F.lit(0).alias("part"),
        F.col("p.stage").alias("stage"),
        F.col("p.status").alias("status"),
        F.col("p.message").alias("message"),
        F.col("p.iteration").alias("iteration"),
    )
    notices = F.array(
        *[
            F.struct(
                F.lit(part).alias("part"),
                F.lit("RETRIEVAL").alias("stage"),
                F.lit(status).alias("status"),
                F.lit(message).alias("message"),
            )
            for part, (status, message) in enumerate(EXPANSION_NOTICES)
        ]
    )
    widened = (
        events.filter("event = 'scope_expansion'")
        .filter(F.from_json("data", SCOPE_EXPANSION).isNotNull())
        .select("message_id", "seq", F.explode(notices).alias("n"))
        .select("message_id", "seq", "n.*", F.lit(None).cast("int").alias("iteration"))
    )
    return plain.unionByName(widened)
