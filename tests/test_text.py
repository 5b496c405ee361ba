import random

import pytest
from pyspark.sql import functions as F

from loomlight.functions import images, intent, text
from loomlight.functions.stemming import stem
from loomlight.operators.chunking import WHITESPACE, chunk_documents, split_text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Annual_Report-2024.final.PDF", "annual report 2024.final"),
        ("  plain ", "plain"),
        ("v1.2 notes", "v1"),
        (None, ""),
    ],
)
def test_normalize_source_name(spark, name, expected):
    assert one(spark, text.normalize_source_name(F.lit(name).cast("string"))) == expected


def test_content_hash_ignores_white_space_only(spark):
    a = one(spark, text.content_hash(F.lit("\t a  b\n\nc \x0b")))
    b = one(spark, text.content_hash(F.lit("a b c")))
    c = one(spark, text.content_hash(F.lit("a b  C")))
    assert a == b != c


def test_upload_prefix_and_slug(spark):
    stored = F.lit("0A234567-89ab-cdef-0123-456789abcdef_my.pdf")
    assert one(spark, text.strip_upload_prefix(stored)) == "my.pdf"
    assert one(spark, text.export_file_name(F.lit(" Hi!  there? "), F.lit(7))) == "Hi-there.pdf"
    assert one(spark, text.export_file_name(F.lit("!!!"), F.lit(7))) == "session-7.pdf"
    assert one(spark, text.export_file_name(F.lit(" "), F.lit(7))) == "session.pdf"


def test_page_title(spark):
    assert one(spark, text.page_title(F.lit("https://w.example/wiki/A%20b+c"))) == "A b c"
    assert one(spark, text.page_title(F.lit("Given title"))) == "Given title"


def test_citation_score_rounds_half_up(spark):
    assert one(spark, text.citation_score(F.lit(0.0), F.lit(0.0625))) == 0.063
    assert one(spark, text.citation_score(F.lit(0.5), F.lit(0.1))) == 0.5


def test_word_count_keeps_a_leading_gap(spark):
    assert one(spark, text.word_count(F.lit(" a b "))) == 3
    assert one(spark, text.word_count(F.lit("a b"))) == 2


def test_jaccard_of_empty_sets(spark):
    empty = text.word_set(F.lit("a b"))
    assert one(spark, text.jaccard(empty, text.word_set(F.lit("alpha")))) == 0.0


def test_question_lines(spark):
    raw = F.lit("1. First?\r\n\r\n- \"Second?\n* Third?\n4) Fourth?")
    assert one(spark, text.question_lines(raw)) == ["First?", "Second?", "Third?"]


def test_visual_title(spark):
    caption = F.lit("[Summary: The chart showing sales by year. More]")
    assert one(spark, images.visual_title(caption, F.lit("s"))) == "Sales by year"
    assert one(spark, images.visual_title(F.lit("nothing"), F.lit("s"))) == "Image from s"


def test_visual_title_of_odd_letters_and_line_separators(spark):
    titles = {
        "ßa b. More": "ẞa b",
        "ᾳx": "ᾼx",
        "ŉx": "ŉx",
        "éx": "Éx",
        "a\rb\x85c\u2028d": "A\rb\x85c\u2028d",
        "a\nb": "Image from s",
    }
    for summary, title in titles.items():
        caption = F.lit(f"[Summary: {summary}]")
        assert one(spark, images.visual_title(caption, F.lit("s"))) == title


@pytest.mark.parametrize(
    "question, expected",
    [
        ("Hi", "GREETING_ACK"),
        ("hello dear friend", "GREETING_ACK"),
        ("hello dear old friend", None),
        ("What did I upload today?", "SESSION_INFO"),
        ("what did i ask", "META_HISTORY"),
        ("earlier you said so", "META_HISTORY"),
        ("who are you?", "BOT_QA"),
        ("explain entropy", None),
    ],
)
def test_fast_intent(spark, question, expected):
    assert one(spark, intent.fast_intent(intent.clean_query(F.lit(question)))) == expected


def test_deictic_words_have_ascii_edges(spark):
    ask = lambda q: one(spark, intent.is_deictic(F.lit(q)))
    assert ask("summarise this report") and ask("éthe") and not ask("thesis")
    assert not ask("two lines\nof this")


def test_routing_fallbacks(spark):
    def routed(raw):
        return one(spark, intent.parse_routing(F.lit(raw), F.lit("my question")))

    prose = routed('Sure: {"strategy": "X", "plans": [{"purpose": "p"}]} bye')
    assert prose.strategy == "X" and prose.plans[0].purpose == "p"
    assert prose.plans[0].optimized_query is None
    for broken in ("no json at all", "{not json}", "{"):
        fallback = routed(broken)
        assert fallback.execution_tier == "DIRECT"
        assert fallback.plans[0].optimized_query == "my question"
    assert routed('{"plans": []}').plans == []


def test_next_action(spark):
    def action(raw):
        return one(spark, intent.parse_next_action(F.lit(raw)))

    assert action('x {"type":"SEARCH","reasoning":"r","next_query":"q"}').next_query == "q"
    stop = action('{"type":"STOP","next_query":"q"}')
    assert (stop.type, stop.next_query) == ("STOP", None)
    assert action("garbage").type == "STOP"


def test_published_stems():
    pairs = {
        "consistently": "consist", "consolations": "consol", "knackeries": "knackeri",
        "conspicuously": "conspicu", "knightly": "knight", "hopping": "hop", "hoping": "hope",
        "generally": "general", "happiness": "happi", "skies": "sky", "succeeding": "succeed",
    }
    assert {w: stem(w) for w in pairs} == pairs


def slow_split(source):
    """The cut rules read literally, character by character."""
    start, before, out = 0, None, []
    while start < len(source):
        end = min(start + 1000, len(source))
        if end < len(source):
            low = start + 400
            doubles = [i + 2 for i in range(end + 1) if source[i : i + 2] == "\n\n" and i >= low]
            stops = [
                i + 1
                for i in range(start + 1, end)
                if source[i] in ".!?" and source[i + 1] in WHITESPACE and i + 1 >= low
            ]
            lines = [i for i in range(low, end + 1) if source[i] == "\n"]
            gaps = [i for i in range(low, end + 1) if source[i] == " "]
            end = next((found[-1] for found in (doubles, stops, lines, gaps) if found), end)
        piece = source[start:end].strip(WHITESPACE)
        if piece and piece != before:
            out.append(piece)
            before = piece
        start = end - 200 if end - 200 > start else end
    return out


def test_chunks_follow_the_rules():
    rng = random.Random(5)
    sizes = [0, 1, 200, 201, 999, 1000, 1001, 1002, 1500, 3000]
    alphabets = ["ab .\n", "a", "a\n", " .", "abc!? \n\n", "x" * 200 + " .\n", "  "]
    for _ in range(200):
        source = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice(sizes)))
        assert list(split_text(source)) == slow_split(source)


def test_chunk_tail_and_totals(spark):
    source = [(1, "word " * 300), (2, "short"), (3, ""), (4, None)]
    rows = chunk_documents(spark.createDataFrame(source, "id int, text string")).collect()
    by_id = {}
    for row in rows:
        by_id.setdefault(row.id, []).append(row)
    assert set(by_id) == {1, 2}
    for found in by_id.values():
        assert [r.chunk_index for r in found] == list(range(len(found)))
        assert {r.total_chunks for r in found} == {len(found)}
        assert all(len(r.content) <= 1000 for r in found)
    assert by_id[1][-2].content.endswith(by_id[1][-1].content)
