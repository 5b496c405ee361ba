"""String, hash, array and number functions over columns.

Regular expressions are ASCII classes (``\\s``, ``\\W``, ``\\d``) throughout,
as in Java without Unicode flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the text products.
EXCERPT_CHARS = 200
QUESTION_CONTEXT_CHARS = 12_000
SUMMARY_CONTEXT_CHARS = 18_000
TITLE_CHARS = 40
VISUAL_TITLE_CHARS = 60
QUESTION_COUNT = 3
CHARS_PER_TOKEN = 4
MIN_WORD_CHARS = 3

CONTROL_CHARS = "".join(map(chr, range(0x21)))

# Patterns.
UPLOAD_ID_PREFIX = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}_"
)
CITATION_MARKER = r"\[CITE:\s*[\d,\s]+]"
UPLOAD_ANCHOR = "[file upload:"
LINK_ANCHOR = "[wikipedia link:"
VISUAL_LEAD = (
    r"^(?i)(A|The|This) (detailed |descriptive )?(diagram|image|chart|screenshot|photo) "
    r"(showing|of|illustrating|comparing) "
)


def java_trim(text: Column) -> Column:
    """Drop leading and trailing characters up to U+0020, not only spaces."""
    return F.btrim(text, F.lit(CONTROL_CHARS))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^\s\u001c-\u001f]")


def normalize_source_name(name: Column) -> Column:
    """File name without extension, separators as spaces, lower case; '' for null."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    spaced = F.regexp_replace(stem, r"[_\-]", " ")
    return F.coalesce(java_trim(F.lower(spaced)), F.lit(""))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with runs of white space collapsed.

    Never null (a missing text gives ''), so a join on it adds no null test
    that would compute the hash once more.
    """
    return F.coalesce(F.sha2(F.regexp_replace(java_trim(text), r"\s+", " "), 256), F.lit(""))


def strip_upload_prefix(stored_name: Column) -> Column:
    return F.regexp_replace(stored_name, UPLOAD_ID_PREFIX, "")


def export_file_name(title: Column, session_id: Column) -> Column:
    """Slug of a session title with ``.pdf``; the session id when nothing is left."""
    usable = F.when(is_blank(title), F.lit("session")).otherwise(title)
    kept = java_trim(F.regexp_replace(usable, r"[^a-zA-Z0-9\-_ ]", ""))
    slug = F.regexp_replace(kept, r"\s+", "-")
    fallback = F.concat(F.lit("session-"), session_id.cast("string"))
    return F.concat(F.when(slug == "", fallback).otherwise(slug), F.lit(".pdf"))


def page_title(url: Column) -> Column:
    """Decoded last path segment of an http address; any other text is a title already."""
    last = F.substring_index(url, "/", -1)
    return F.when(url.startswith("http"), F.try_url_decode(last)).otherwise(url)


def page_url(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def is_upload_anchor(content: Column) -> Column:
    return F.coalesce(
        content.startswith(UPLOAD_ANCHOR) | content.startswith(LINK_ANCHOR), F.lit(False)
    )


def strip_citation_markers(content: Column) -> Column:
    return F.regexp_replace(content, CITATION_MARKER, "")


def word_count(text: Column) -> Column:
    """Parts between white space; a leading gap counts as one empty part."""
    return F.size(F.split(F.regexp_replace(text, r"\s+$", ""), r"\s+"))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of three and more characters."""
    words = F.split(F.lower(text), r"\W+")
    kept = F.array_distinct(F.filter(words, lambda w: F.length(w) >= MIN_WORD_CHARS))
    return F.coalesce(kept, F.array().cast("array<string>"))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets held as distinct arrays; 0 when one is empty."""
    common = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - common
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(common / union)


def question_lines(raw: Column) -> Column:
    """Up to three questions, one per line, without list marks."""
    bullets = r"""^[\s\-*•\d.)"']+"""
    lines = F.transform(
        F.split(raw, r"\r?\n"), lambda line: java_trim(F.regexp_replace(line, bullets, ""))
    )
    return F.slice(F.filter(lines, lambda line: ~is_blank(line)), 1, QUESTION_COUNT)


def token_estimate(content: Column) -> Column:
    return F.coalesce(F.floor(F.length(content) / CHARS_PER_TOKEN), F.lit(0)).cast("bigint")


def bounded(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.substring(text, 1, limit)).otherwise(text)


def short_title(text: Column, limit: int = TITLE_CHARS) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def excerpt(text: Column) -> Column:
    return F.concat(F.substring(text, 1, EXCERPT_CHARS), F.lit("…"))


def citation_score(final: Column, semantic: Column) -> Column:
    """Final score, or the semantic one when it is zero, half-up to three decimals."""
    score = F.when(final == 0.0, semantic).otherwise(final)
    return F.floor(score * 1000.0 + 0.5) / 1000.0


def section_path(h2: Column, h3: Column, h4: Column) -> Column:
    path = F.concat_ws(" > ", h2, h3, h4)
    return F.when(h2.isNull() & h3.isNull() & h4.isNull(), F.lit("Lead")).otherwise(path)


def section_content(page: Column, section: Column, text: Column) -> Column:
    return F.format_string("Page: %s\nSection: %s\n\n%s", page, section, text)


def display_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def image_mime(file_name: Column) -> Column:
    lower = F.lower(file_name)
    return (
        F.when(lower.endswith(".png"), "image/png")
        .when(lower.endswith(".webp"), "image/webp")
        .otherwise("image/jpeg")
    )


def attachment_type(mime: Column) -> Column:
    """PDF, IMAGE, TEXT or OTHER from a MIME type."""
    lower = F.lower(mime)
    return (
        F.when(lower.contains("pdf"), "PDF")
        .when(lower.startswith("image/"), "IMAGE")
        .when(lower.contains("text/") | lower.contains("markdown"), "TEXT")
        .otherwise("OTHER")
    )


def storage_folder(kind: Column) -> Column:
    return (
        F.when(kind == "PDF", "pdfs")
        .when(kind == "IMAGE", "images")
        .when(kind == "TEXT", "texts")
        .otherwise("other")
    )


def sigmoid_score(logit: Column) -> Column:
    """Logistic score in single precision."""
    return (1.0 / (1.0 + F.exp(-logit))).cast("float")


def contains_text(needle: str, *columns: Column) -> Column:
    """True when any column contains the needle, ignoring case; a blank needle matches all."""
    if not needle.strip():
        return F.lit(True)
    wanted = needle.lower()
    found = F.lit(False)
    for column in columns:
        found = found | F.lower(F.coalesce(column, F.lit(""))).contains(wanted)
    return found
