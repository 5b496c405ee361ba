"""Daily counters and visits from streams whose rows may come at any time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType

DAY_MS = 86_400_000
# Parts that the users of a day are dealt to; fixed for the life of a stream.
USER_PARTS = 32


def daily_counters(outcomes: DataFrame) -> DataFrame:
    """Running counters per day from (ts, kind, succeeded, tokens, duration_ms).

    Documents and exports count on success, chats once generated. The state is
    one row a day, so no day is ever closed and a row counts however late it
    comes. Run it in update mode; ``sources.manifest.upsert_rows`` keeps the newest row of
    each day.
    """
    chat = (F.col("kind") == "chat") & F.col("succeeded")
    return outcomes.groupBy(F.to_date("ts").alias("date")).agg(
        F.count_if(chat).alias("chat_requests"),
        F.count_if((F.col("kind") == "document") & F.col("succeeded")).alias("documents_uploaded"),
        F.count_if((F.col("kind") == "export") & F.col("succeeded")).alias("pdf_exports"),
        F.sum(F.when(chat, F.col("tokens")).otherwise(0)).alias("tokens_generated"),
        F.avg(F.when(chat, F.col("duration_ms"))).alias("avg_response_ms"),
    )


def _earliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One visit per (date, user) of each batch, so that a busy user costs a task few rows."""
    for batch in batches:
        yield batch.sort_values("ts", kind="stable").drop_duplicates(["date", "user_id"])


def _visitor(retention_ms: int, user: str) -> StatefulProcessor:
    """Built here so that it travels with its code to Spark's stream runner."""

    class Visitor(StatefulProcessor):
        """Which users of one part were seen on one day; forgotten once the day is past retention."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            # One element a batch.
            self.seen = handle.getListState("seen", f"users array<{user}>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True)
            if batch.empty:
                return
            first = batch.sort_values("ts", kind="stable").drop_duplicates("user_id")
            if self.seen.exists():
                if key[1] < 0:
                    return
                first = first[~first["user_id"].isin([u for (users,) in self.seen.get() for u in users])]
            if first.empty:
                return
            day_end = int(pd.Timestamp(key[0]).value // 1_000_000) + DAY_MS
            past = day_end + retention_ms <= timerValues.getCurrentWatermarkInMs()
            if not past:
                users = [] if key[1] < 0 else first["user_id"].tolist()
                self.seen.appendValue((users,))
                self.handle.registerTimer(day_end + retention_ms)
            yield first.assign(past_retention=past)[["date", "user_id", "ts", "past_retention"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.seen.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Visitor()


def first_visits(visits: DataFrame, retention: str = "30 days", late: str = "1 hour") -> DataFrame:
    """(date, user_id, ts, past_retention): visits that find no earlier one of their user and day.

    State is kept per date and part of the users and leaves by event time, ``retention`` after
    the day, as seen from the newest row less ``late``. A visit that comes later
    still is not dropped: nobody remembers whether its user was seen, so it is
    given with ``past_retention`` set. ``daily_visitors`` counts both right.
    Needs the RocksDB state store.
    """
    kind = visits.schema["user_id"].dataType
    # As texts, whole numbers next to a missing user stay whole.
    user = "string" if isinstance(kind, IntegralType) else kind.simpleString()
    # A pandas function gives plain columns: Spark's own filter of late rows finds no event time.
    dated = visits.withWatermark("ts", late).select(F.to_date("ts").alias("date"), F.col("user_id").cast(user).alias("user_id"), "ts")
    thinned = dated.mapInPandas(_earliest, f"date date, user_id {user}, ts timestamp")
    # Users share state keys; a missing user has a part of its own.
    part = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(USER_PARTS))).otherwise(-1)
    firsts = thinned.withColumn("_part", part).groupBy("date", "_part").transformWithStateInPandas(
        statefulProcessor=_visitor(int(pd.Timedelta(retention).total_seconds() * 1000), user),
        outputStructType=f"date date, user_id {user}, ts timestamp, past_retention boolean",
        outputMode="append",
        timeMode="EventTime",
    )
    return firsts.withColumn("user_id", F.col("user_id").cast(kind))


def split_by_retention(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first visits, the side table of visits past retention)."""
    rows = firsts.drop("past_retention")
    return rows.filter(~firsts.past_retention), rows.filter(firsts.past_retention)


def daily_visitors(firsts: DataFrame) -> DataFrame:
    """Visitors per day, each once, whether their visit was in time or past retention."""
    return firsts.select("date", "user_id").distinct().groupBy("date").agg(F.count(F.lit(1)).alias("unique_visitors"))
