"""Text products of described images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomlight.functions.text import VISUAL_LEAD, VISUAL_TITLE_CHARS, is_blank, java_trim


# Letters whose upper case is several letters, and the one letter that stands for it, if any.
_WIDENED = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
_CAPITALS = {c: c.title() if len(c.title()) == 1 else c for c in _WIDENED} | {"ß": "ẞ"}


def capital_letter(letter: Column) -> Column:
    """Upper case of one character, as one character."""
    one = F.translate(letter, "".join(_CAPITALS), "".join(_CAPITALS.values()))
    return F.when(letter.isin(*_CAPITALS), one).otherwise(F.upper(letter))


def _labelled(label: str, value: Column) -> Column:
    return F.when(~is_blank(value), F.concat(F.lit(f"[{label}: "), value, F.lit("]")))


def _listed(label: str, values: Column, separator: str) -> Column:
    joined = F.concat(F.lit(f"[{label}: "), F.array_join(values, separator), F.lit("]"))
    return F.when(F.size(values) > 0, joined)


def dense_image_text(image: Column) -> Column:
    """Labelled lines of an image description, empty fields left out.

    ``image`` is a struct of summary, keywords, technologies, objects,
    relationships, ocr and image_type.
    """
    lines = [
        _labelled("Image Type", image["image_type"]),
        _labelled("Summary", image["summary"]),
        _listed("Objects", image["objects"], ", "),
        _listed("Technologies", image["technologies"], ", "),
        _listed("Relationships", image["relationships"], "; "),
        _labelled("OCR Text", image["ocr"]),
        _listed("Keywords", image["keywords"], ", "),
    ]
    return java_trim(F.concat_ws("\n", *lines))


def visual_title(caption: Column, source: Column) -> Column:
    """First sentence of the caption's summary without its boilerplate lead."""
    # Only a line feed ends a line; a plain dot would stop at other separators, too.
    summary = java_trim(F.regexp_extract(caption, r"\[Summary: ([^\n]*?)\]", 1))
    sentence = F.split(summary, r"\.")[0]
    subject = F.regexp_replace(sentence, VISUAL_LEAD, "")
    cut = F.when(
        F.length(subject) > VISUAL_TITLE_CHARS,
        F.concat(F.substring(subject, 1, VISUAL_TITLE_CHARS), F.lit("...")),
    ).otherwise(subject)
    capital = F.concat(capital_letter(F.substring(cut, 1, 1)), F.substring(cut, 2, 1 << 30))
    fallback = F.concat(F.lit("Image from "), F.coalesce(source, F.lit("null")))
    return F.when(cut.isNull() | (cut == ""), fallback).otherwise(capital)


def _section(label: str, text: Column) -> Column:
    return F.when(~is_blank(text), F.concat(F.lit(f"\n--- {label} ---\n"), java_trim(text)))


def paged_image_context(previous: Column, current: Column, following: Column) -> Column:
    """Context of an image on a page of a document, with the pages around it."""
    return F.concat_ws(
        "",
        F.lit("Source: Enterprise Document (PDF)\n"),
        _section("PREVIOUS SECTION", previous),
        _section("CURRENT SECTION", current),
        _section("NEXT SECTION", following),
    )


def _line(label: str, text: Column) -> Column:
    return F.when(~is_blank(text), F.concat(F.lit(f"{label}: "), text, F.lit("\n")))


def article_image_context(
    title: Column, section: Column, surrounding: Column, caption: Column
) -> Column:
    return F.concat_ws(
        "",
        F.lit("Source: Wikipedia Article\n"),
        F.concat(F.lit("Title: "), title, F.lit("\n")),
        _line("Section", section),
        _line("Image Caption", caption),
        _section("SURROUNDING TEXT", surrounding),
    )


def standalone_image_context(file_name: Column, prompt: Column) -> Column:
    return F.concat_ws(
        "",
        F.lit("Source: Standalone Upload\n"),
        _line("Filename", file_name),
        _line("User Prompt / Description", prompt),
    )
