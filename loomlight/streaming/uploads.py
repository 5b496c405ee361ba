"""State of the uploads of a session, kept for five minutes after its last change."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from loomlight.functions.text import normalize_source_name
from loomlight.lineage import materialize
from loomlight.operators.aliases import NEWEST, ORDINALS

# Fixed values.
STATE_MINUTES = 5
STATES = ["UPLOADING", "EMBEDDING", "INGESTING", "READY", "FAILED"]
BUSY = ["EMBEDDING", "INGESTING"]
# State keys that sessions are dealt to; fixed for the life of a stream.
SESSION_BUCKETS = 512


def upload_states(events: DataFrame, as_of: Column) -> DataFrame:
    """State of every session at ``as_of``: session_id, state, names, changed_at.

    ``events`` has session_id, ts, event_id, state and file_name; ``as_of`` may
    differ between sessions. A session untouched for five minutes has no state,
    and what it held is forgotten: only its last life counts, the events since
    the last gap of five minutes. Whether an event has one in the five minutes
    before it is seen in buckets of that width, each with a copy of the bucket
    before, so a long session is cut by time. The batch form of
    :func:`track_uploads`.
    """
    life = F.expr(f"interval '{STATE_MINUTES}' minute")
    seen = events.withColumn("_as_of", as_of).filter(F.col("ts") <= F.col("_as_of"))
    width = STATE_MINUTES * 60 * 1_000_000
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / width)
    copied = seen.select(
        "session_id", "ts", "event_id", F.explode(F.array(bucket, bucket + 1)).alias("bucket"), bucket.alias("own")
    )
    order = Window.partitionBy("session_id", "bucket").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    follows = F.coalesce(before + life > F.col("ts"), F.lit(False))
    starts = (
        copied.withColumn("_follows", follows)
        .filter("bucket = own and not _follows")
        .groupBy("session_id")
        .agg(F.max("ts").alias("_born"))
    )
    starts = materialize(starts, "lives")
    lives = seen.join(starts, "session_id").filter(F.col("ts") >= F.col("_born"))
    states = lives.groupBy("session_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
        F.countDistinct("file_name").alias("names"),
        F.max("ts").alias("changed_at"),
        F.first("_as_of").alias("_as_of"),
    )
    return states.filter(F.col("changed_at") + life > F.col("_as_of")).drop("_as_of")


def _tracker() -> StatefulProcessor:
    """Built here so that it travels with its code to Spark's stream runner."""

    class Tracker(StatefulProcessor):
        """State and file names of one session; they expire together."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            # The longest a state can be of use; lives end by the events' own times.
            keep = 24 * 3600 * 1000
            self.state = handle.getValueState("state", "state string, at bigint", ttlDurationMs=keep)
            self.names = handle.getMapState("names", "name string", "place int", ttlDurationMs=keep)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            state, at = self.state.get() if self.state.exists() else (STATES[0], None)
            known = sum(1 for _ in self.names.keys())
            batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
            for when, new, name in batch[["ts", "state", "file_name"]].itertuples(index=False):
                ms = int(pd.Timestamp(when).value // 1_000_000)
                if at is not None and ms < at:
                    continue  # late: a newer event has set the state
                if at is not None and ms - at >= STATE_MINUTES * 60_000:
                    self.names.clear()
                    known = 0
                state, at = new, ms
                if name and not self.names.containsKey((name,)):
                    known += 1
                    self.names.updateValue((name,), (known,))
            self.state.update((state, at))
            yield pd.DataFrame({"session_id": [key[0]], "state": [state], "names": [known]})

        def close(self) -> None:
            pass

    return Tracker()


def track_uploads(events: DataFrame) -> DataFrame:
    """Current state of each session touched in a batch, from a stream of events."""
    return events.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_tracker(),
        outputStructType="session_id bigint, state string, names bigint",
        outputMode="update",
        timeMode="ProcessingTime",
    )


def _keeper(ordinals: list[str], newest: list[str]) -> StatefulProcessor:
    """Built here so that it travels with its code to Spark's stream runner."""
    life_ms = STATE_MINUTES * 60_000
    words_of = re.compile(r"\s+")
    columns = ["session_id", "state", "began", "changed", "names", "aliases", "kind", "file_name"]

    class Keeper(StatefulProcessor):
        """State, names, ordinals and aliases of the sessions of a bucket; those of a session end together."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # One element a batch.
            self.early = handle.getListState(
                "early",
                "sessions array<string>, ms array<bigint>, event_ids array<bigint>, states array<string>, "
                "file_names array<string>, spoken array<string>",
            )
            # One element a session whose life has begun and not ended.
            self.lives = handle.getListState(
                "lives",
                "session string, state string, began bigint, changed bigint, names array<string>, "
                "aliases array<string>, files array<string>",
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True)
            # A filter of rows without a session would be moved below the watermark.
            batch = batch[batch["session_id"].notna()]
            late = batch["ms"] < timerValues.getCurrentWatermarkInMs()
            early = batch[~late]
            if len(early):
                self.hold(early[["session_id", "ms", "event_id", "state", "file_name", "spoken"]].itertuples(index=False))
                self.handle.registerTimer(int(early["ms"].min()))
            out = [
                (session, state, int(ms), int(ms), 0, [], "late", name)
                for session, ms, state, name in batch.loc[late, ["session_id", "ms", "state", "file_name"]].itertuples(index=False)
            ]
            if out:
                yield pd.DataFrame(out, columns=columns)

        def hold(self, events, anew: bool = False) -> None:
            sessions, ms, ids, states, names, spoken = map(list, zip(*events))
            piece = (sessions, [int(m) for m in ms], [int(i) for i in ids], states, names, spoken)
            self.early.put([piece]) if anew else self.early.appendValue(piece)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            pieces = self.early.get() if self.early.exists() else ()
            held = sorted((e for piece in pieces for e in zip(*piece, strict=True)), key=lambda e: (e[1], e[2]))
            due = [e for e in held if e[1] < now]
            rest = held[len(due) :]
            # Per session: state, began, changed, names in order, files by alias.
            lives: dict[str, list] = {}
            for session, state, began, changed, names, aliases, files in self.lives.get() if self.lives.exists() else ():
                lives[session] = [state, began, changed, dict.fromkeys(names), dict(zip(aliases, files, strict=True))]
            out, touched = [], set()

            def give(session: str, kind: str) -> None:
                state, began, changed, names, aliases = lives[session]
                pairs = [{"alias": a, "file_name": f} for a, f in sorted(aliases.items())]
                out.append((session, state, began, changed, len(names), pairs, kind, None))

            for session, ms, _, state, name, spoken in due:
                if session in lives and ms - lives[session][2] >= life_ms:
                    give(session, "ended")
                    del lives[session]
                life = lives.setdefault(session, [None, ms, ms, {}, {}])
                names, aliases = life[3], life[4]
                if name is not None and name.strip():
                    if name not in names:
                        names[name] = None
                        if len(names) <= len(ordinals):
                            aliases[ordinals[len(names) - 1]] = name
                    for word in [*newest, *(w for w in words_of.split(spoken or "") if w)]:
                        aliases[word] = name
                life[0], life[2] = state, ms
                touched.add(session)
            ended = [session for session, life in lives.items() if life[2] + life_ms < now]
            for session in ended:
                give(session, "ended")
                del lives[session]
            for session in touched & lives.keys():
                give(session, "live")
            if due:
                self.hold(rest, anew=True) if rest else self.early.clear()
            if due or ended:
                kept = [
                    (session, state, began, changed, list(names), list(aliases), list(aliases.values()))
                    for session, (state, began, changed, names, aliases) in lives.items()
                ]
                self.lives.put(kept) if kept else self.lives.clear()
                moments = [life[2] + life_ms for life in lives.values()] + [e[1] for e in rest[:1]]
                if moments:
                    self.handle.registerTimer(min(moments))
            if out:
                yield pd.DataFrame(out, columns=columns)

        def close(self) -> None:
            pass

    return Keeper()


def session_lives(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Upload state of sessions with their names and aliases, from a stream in any order.

    ``events`` has session_id, ts, event_id, state and file_name. Events are
    held until the newest row is ``delay`` ahead and then applied in order of
    time, so the order of arrival does not matter. A name gets the next ordinal
    word at its first upload in a life, and the newest words and its own words
    again at every upload. A life ends by event time, five minutes after its
    last event. Rows: kind ``live`` after events were applied, ``ended`` once a
    life, with its final state, and ``late`` for an event that came after its
    time was settled; that one changes nothing but is not lost. Rows with a null
    session only move the time on. Sessions share ``SESSION_BUCKETS`` state keys, so a batch
    asks the state store a few times per bucket. Needs the RocksDB state store.
    """
    session = events.schema["session_id"].dataType
    # A plain number: Spark's own filter of late rows finds no event time. Ids go as texts: beside
    # missing ones, whole numbers would not stay whole.
    timed = events.withWatermark("ts", delay).select(
        F.col("session_id").cast("string").alias("session_id"), F.unix_millis("ts").alias("ms"),
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(0)).cast("string").alias("event_id"), "state", "file_name",
        normalize_source_name(F.col("file_name")).alias("spoken"),
        F.pmod(F.xxhash64("session_id"), F.lit(SESSION_BUCKETS)).alias("_bucket"),
    )
    return (
        timed.groupBy("_bucket")
        .transformWithStateInPandas(
            statefulProcessor=_keeper(ORDINALS, NEWEST),
            outputStructType="session_id string, state string, began bigint, changed bigint, names int, "
            "aliases array<struct<alias string, file_name string>>, kind string, file_name string",
            outputMode="append",
            timeMode="EventTime",
        )
        .withColumns({
            "session_id": F.col("session_id").cast(session),
            "began": F.timestamp_millis("began"), "changed": F.timestamp_millis("changed"),
        })
    )
