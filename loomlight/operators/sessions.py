"""Session products: history, transcripts, listings, access and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions.prompts import history_line
from loomlight.functions.text import (
    QUESTION_CONTEXT_CHARS,
    SUMMARY_CONTEXT_CHARS,
    display_timestamp,
    is_blank,
    is_upload_anchor,
    java_trim,
)
from loomlight.ordering import join_segments, number_rows, top_k

# Fixed values.
HISTORY_MESSAGES = 10
FOLLOW_UP_MESSAGES = 6
MESSAGE_CAP = 60
PAGE_SIZE = 24
TEXT_SEPARATOR = "\n\n---\n\n"
NO_SUMMARY = "No summary available for this session."
ASSISTANT_ROLES = ["ASSISTANT", "MODEL"]

SEGMENT_MESSAGES = 100


def recent_messages(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last n messages per session; ``recency`` 1 is the newest."""
    newest = [F.col("created_at").desc(), F.col("message_id").desc()]
    return top_k(messages, ["session_id"], newest, n, "recency")


def _join_recent(recent: DataFrame, line: Column) -> DataFrame:
    """Lines of the kept messages, oldest first; a session has at most ten."""
    oldest_first = F.array_sort(
        F.collect_list(F.struct((-F.col("recency")).alias("at"), line.alias("line")))
    )
    joined = F.array_join(F.transform(oldest_first, lambda m: m["line"]), "\n")
    return recent.groupBy("session_id").agg(java_trim(joined).alias("history"))


def history_blocks(messages: DataFrame) -> DataFrame:
    """Conversation history per session: the last ten messages."""
    return _join_recent(recent_messages(messages), history_line(F.col("role"), F.col("content")))


def follow_up_blocks(messages: DataFrame) -> DataFrame:
    """The last six messages per session; blanks are dropped after the cut."""
    text = java_trim(F.coalesce("content", F.lit("")))
    kept = recent_messages(messages, FOLLOW_UP_MESSAGES).withColumn("content", text)
    return _join_recent(
        kept.filter("content != ''"), history_line(F.col("role"), F.col("content"))
    )


def transcript_lines(assistant: str = "Assistant") -> Column:
    """Markdown of one message; null for a blank one."""
    heading = (
        F.when(F.upper("role") == "USER", "You")
        .when(F.upper("role").isin(ASSISTANT_ROLES), assistant)
        .otherwise(F.col("role"))
    )
    spoken = F.concat(F.lit("### "), heading, F.lit("\n"), F.col("content"), F.lit("\n\n"))
    upload = F.concat(F.lit("📎 *"), F.col("content"), F.lit("*\n\n"))
    is_upload = (F.upper("role") == "USER") & is_upload_anchor(F.col("content"))
    return F.when(~is_blank(F.col("content")), F.when(is_upload, upload).otherwise(spoken))


def transcripts(
    sessions: DataFrame, messages: DataFrame, assistant: str = "Assistant"
) -> DataFrame:
    """Markdown transcript per session as (session_id, segment_no, text).

    Messages are numbered in time order and joined a hundred at a time, so a
    session of any length is spread; sessions under the message cap have one
    segment. The head with title, date and summary opens segment 0.
    """
    lines = messages.select(
        "session_id", "created_at", "message_id", transcript_lines(assistant).alias("line")
    ).filter("line is not null")
    numbered = number_rows(lines, ["session_id"], ["created_at", "message_id"])
    bodies = join_segments(
        numbered, ["session_id"], "position", "line", size=SEGMENT_MESSAGES, out="body"
    )
    summary = F.when(is_blank(F.col("summary")), NO_SUMMARY).otherwise(F.col("summary"))
    head = F.concat(
        F.lit("# "),
        F.coalesce("title", F.lit("Chat Session")),
        F.lit("\n\n**Created:** "),
        display_timestamp(F.col("created_at")),
        F.lit("\n\n---\n\n## Session Summary\n\n"),
        summary,
        F.lit("\n\n---\n\n"),
    )
    heads = sessions.select(
        "session_id", F.lit(0).cast("bigint").alias("segment_no"), head.alias("head")
    )
    whole = heads.join(bodies, ["session_id", "segment_no"], "full_outer")
    return whole.select(
        "session_id",
        "segment_no",
        F.concat(F.coalesce("head", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"),
    ).join(sessions.select("session_id"), "session_id", "left_semi")


def summary_inputs(messages: DataFrame) -> DataFrame:
    """Text to summarise per session: the first 18,000 characters of its conversation.

    Only messages that can reach the limit are gathered: each line takes at
    least the speaker, a character and a line break.
    """
    line = history_line(F.col("role"), java_trim(F.col("content")))
    said = messages.filter(
        ~is_blank(F.col("content")) & ~is_upload_anchor(F.col("content"))
    ).select("session_id", "created_at", "message_id", line.alias("line"))
    return _first_characters(
        said, ["created_at", "message_id"], "line", "\n", SUMMARY_CONTEXT_CHARS, 8, "conversation"
    )


def session_texts(texts: DataFrame) -> DataFrame:
    """Texts of a session joined in upload order, cut at 12,000 characters."""
    kept = texts.filter(~is_blank(F.col("text")))
    return _first_characters(
        kept, ["uploaded_at", "doc_id"], "text", TEXT_SEPARATOR, QUESTION_CONTEXT_CHARS, 8, "text"
    )


def _first_characters(
    rows: DataFrame, order: list[str], text: str, separator: str, limit: int, least: int, out: str
) -> DataFrame:
    """Join a session's texts in order and cut at ``limit`` characters, exactly.

    A text with its separator takes at least ``least`` characters, so the cut
    lies within the first limit / least of them, each cut at the limit too:
    that bounds what a session brings together, however much it holds.
    """
    most = limit // least + 1
    cut = rows.select(
        "session_id", *order, F.substring(F.col(text), 1, limit).alias("_text")
    )
    first = top_k(
        cut, ["session_id"], [F.col(c) for c in order], most, "_at", salt_by=order[-1]
    )
    pieces = F.array_sort(F.collect_list(F.struct("_at", "_text")))
    joined = F.array_join(F.transform(pieces, lambda p: p["_text"]), separator)
    return first.groupBy("session_id").agg(F.substring(joined, 1, limit).alias(out))


def sessions_at_cap(messages: DataFrame, cap: int = MESSAGE_CAP) -> DataFrame:
    """Sessions that take no further message."""
    counted = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    return counted.filter(F.col("messages") >= cap)


def session_attachments(view_attachments: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments listed in each session, the one added last first."""
    listed = view_attachments.select("session_id", "attachment_id", "added_at").join(
        attachments.drop("session_id"), "attachment_id"
    )
    return listed.orderBy(
        "session_id", F.col("added_at").desc(), F.col("attachment_id").desc()
    )


def owned_rows(rows: DataFrame, sessions: DataFrame, caller: int) -> DataFrame:
    """Rows of sessions that belong to the caller."""
    mine = sessions.filter(F.col("user_id") == caller).select("session_id")
    return rows.join(mine, "session_id", "left_semi")


def newest_first(attachments: DataFrame) -> DataFrame:
    return attachments.orderBy(F.col("uploaded_at").desc(), F.col("attachment_id").desc())


def listing_pages(attachments: DataFrame, pages: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The first pages of every user's listing, newest first, and whether more follow.

    Adds listing_rank, page_no from 1 and has_more.
    """
    newest = [F.col("uploaded_at").desc(), F.col("attachment_id").desc()]
    shown = top_k(attachments, ["user_id"], newest, pages * size, "listing_rank")
    totals = attachments.groupBy("user_id").agg(F.count(F.lit(1)).alias("_total"))
    return (
        shown.join(totals, "user_id")
        .withColumn("page_no", F.floor((F.col("listing_rank") - 1) / size) + 1)
        .withColumn("has_more", F.col("_total") > pages * size)
        .drop("_total")
    )


def recent_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with the one touched last first."""
    return sessions.orderBy(F.col("updated_at").desc(), F.col("session_id").desc())


def delete_sessions(
    deleted: DataFrame, messages: DataFrame, view_attachments: DataFrame, attachments: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains of messages, listings and attachments.

    Messages and listings go with their session; attachments stay and lose it.
    """
    gone = deleted.select("session_id").distinct()
    marked = gone.withColumn("_gone", F.lit(True))
    kept = attachments.join(marked, "session_id", "left").withColumn(
        "session_id", F.when(F.col("_gone").isNull(), F.col("session_id"))
    )
    return (
        messages.join(gone, "session_id", "left_anti"),
        view_attachments.join(gone, "session_id", "left_anti"),
        kept.select(attachments.columns),
    )


def neighbour_texts(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Each page with the texts of the pages before and after it.

    Every text goes to its own page and its two neighbours by (document, page),
    which spreads a huge document; a window over it would not. Pages are
    numbered without gaps.
    """
    role = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_role")
    sent = pages.select(document, page, F.col(text).alias("_text"), role)

    def of(value: int) -> Column:
        return F.max(F.when(F.col("_role") == value, F.col("_text")))

    return (
        sent.groupBy(document, (F.col(page) - F.col("_role")).alias(page))
        .agg(
            of(-1).alias("previous_text"),
            of(0).alias("current_text"),
            of(1).alias("next_text"),
            F.max((F.col("_role") == 0).cast("int")).alias("_is_page"),
        )
        .filter("_is_page = 1")
        .drop("_is_page")
    )

