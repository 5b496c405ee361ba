import pytest
from pyspark.sql import functions as F

from loomlight import lineage
from loomlight.operators import aliases, ownership, sessions
from loomlight.operators.evidence import context_blocks, stable_visuals
from loomlight.operators.html import page_sections, section_chunks
from loomlight.plans.ingest import ingest
from loomlight.sources import readers, writers

PAGE = """<html><head><script>var t="</p>";</script></head><body><h1>T</h1>
<p>nineteen characters</p><p><b>Lead paragraph long enough.<br>x
<p>Second lead paragraph, here &amp; there.</p><!-- <p>not a paragraph at all</p> -->
<table class="infobox"><tr><th>Key</th><td>Va<br>lue</td></tr><tr><td>no key</td></tr></table>
<h2>Sec</h2><h3>Sub</h3><h4>Deep</h4><p>A paragraph deep in the page.</p><h3>Other</h3>
<table class="wikitable"><tr><th>A</th><th>B|C</th></tr><tr><td>1<td>2</table>
<table class="plain"><tr><td>ignored</td></tr></table>
<h2>Next</h2><figure><img src="//x/y.png" alt=""></figure>
<figure><img src="/z.png" alt="alt"><figcaption>Cap <i>here</i></figcaption></figure></body>"""


def test_page_sections():
    found = list(page_sections(PAGE, "My Page"))
    assert [c["semantic_id"] for c in found] == [
        "My_Page:summary_1", "My_Page:summary_2", "My_Page:info1", "My_Page:p3",
        "My_Page:table1", "My_Page:img1", "My_Page:img2",
    ]
    assert found[0]["text"] == "Lead paragraph long enough. x"
    assert found[2]["text"] == "**Key**: Va lue\n"
    assert (found[3]["h2"], found[3]["h3"], found[3]["h4"]) == ("Sec", "Sub", "Deep")
    assert (found[4]["h3"], found[4]["h4"]) == ("Other", None)
    assert found[4]["text"] == "| A | B\\|C |\n|---|---|\n| 1 | 2 |\n"
    assert found[5]["text"] == "Image Caption: Image without caption"
    assert found[5]["image_url"] == "https://x/y.png"
    assert found[6]["caption"] == "Cap here"
    assert [c["chunk_order"] for c in found] == list(range(1, 8))


def test_section_rows_keep_page_columns(spark):
    pages = spark.createDataFrame([(1, "My Page", PAGE), (2, "E", None)], "id int, title string, html string")
    rows = section_chunks(pages).collect()
    assert {r.id for r in rows} == {1} and len({r.content_hash for r in rows}) == 1


def test_first_upload_and_deletion(spark):
    rows = [
        (1, 10, "u", 3), (2, 10, "u", 1), (3, 11, "u", 2), (4, 11, "alone", 4), (5, 12, None, 5),
    ]
    owned = spark.createDataFrame(
        rows, "attachment_id int, user_id int, url string, uploaded_at int"
    )
    firsts = ownership.first_uploads(owned, ["url", "user_id"]).collect()
    assert {(r.url, r.user_id): r.attachment_id for r in firsts}[("u", 10)] == 2
    requested = spark.createDataFrame(
        [(1, 10), (4, 11), (5, 12), (3, 99)], "attachment_id int, user_id int"
    )
    decided = {r.attachment_id: r for r in ownership.deletion_decisions(requested, owned).collect()}
    assert set(decided) == {1, 4, 5}
    assert not decided[1].fully_deleted and decided[1].owner_count == 3
    assert decided[4].fully_deleted and decided[5].fully_deleted


def test_aliases_of_repeated_names(spark):
    rows = [(1, 1, "a.pdf", 1), (2, 1, "b.pdf", 2), (3, 1, "a.pdf", 3)]
    uploads = spark.createDataFrame(
        rows, "doc_id int, session_id int, file_name string, uploaded_at int"
    )
    found = {r.alias: r.file_name for r in aliases.session_aliases(uploads).collect()}
    assert found == {
        "first": "a.pdf", "second": "b.pdf", "latest": "a.pdf", "last": "a.pdf",
        "a": "a.pdf", "b": "b.pdf",
    }


def messages(spark, n):
    return spark.range(n).select(
        F.lit(1).cast("bigint").alias("session_id"),
        F.col("id").alias("message_id"),
        F.when(F.col("id") % 2 == 0, "USER").otherwise("ASSISTANT").alias("role"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("content"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + id * interval '1' minute").alias("created_at"),
    )


def test_long_transcripts_come_in_segments_and_files(spark, tmp_path):
    said = messages(spark, 250)
    head = spark.range(1).select(
        F.lit(1).cast("bigint").alias("session_id"),
        F.lit("T").alias("title"),
        F.lit("sum").alias("summary"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"),
    )
    parts = sessions.transcripts(head, said).orderBy("segment_no").collect()
    whole = "".join(p.text for p in parts)
    assert len(parts) == 3 and whole.startswith("# T\n\n**Created:** 2024-01-01 00:00:00")
    assert [f"m{i}" for i in range(250)] == [w for w in whole.split() if w[0] == "m" and w[1:].isdigit()]
    writers.write_transcripts(sessions.transcripts(head, said), str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "session_id=1").glob("part-*.txt"))
    assert "".join(f.read_text() for f in files) == whole


def test_session_texts_cut_exactly_with_many_tiny_texts(spark):
    rows = spark.range(3000).select(
        F.lit(1).alias("session_id"),
        F.col("id").alias("doc_id"),
        F.col("id").alias("uploaded_at"),
        (F.col("id") % 10).cast("string").alias("text"),
    )
    joined = sessions.session_texts(rows).first()["text"]
    assert joined == "\n\n---\n\n".join(str(i % 10) for i in range(3000))[:12_000]


def test_context_has_visuals_then_text_or_says_nothing(spark):
    requests = spark.createDataFrame([(1,), (2,)], "request_id int")
    shown = stable_visuals(
        spark.createDataFrame(
            [(1, 1, "[Summary: A photo of cats. x]", "doc")],
            "request_id int, visual_rank int, caption string, source_name string",
        )
    )
    rows = [(1, 5, "s", "TEXT", "body", "UNION", None)]
    found = spark.createDataFrame(
        rows,
        "request_id int, position int, source_name string, source_type string, content string, "
        "merge_op string, purpose string",
    )
    text = {r.request_id: r.text for r in context_blocks(requests, found, shown).collect()}
    assert text[2] == "No relevant evidence found."
    assert text[1].startswith("=== Visual Evidence ===\nImage 1 (shown above)\nDisplay Title: Cats\n")
    assert text[1].endswith('<CITATION id="1">\nSource: s | Type: TEXT\nbody\n</CITATION>')


def upload(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id bigint, session_id bigint, file_name string, text string"
    ).withColumns(
        {
            "uploaded_at": F.expr("timestamp_ntz'2024-01-01 00:00:00' + doc_id * interval '1' day"),
            "source_type": F.lit("TEXT"),
            "image_url": F.lit(None).cast("string"),
            "source_url": F.lit(None).cast("string"),
        }
    )


def test_ingest_deduplicates_and_repoints(spark, tmp_path):
    first, _ = ingest(upload(spark, [(1, 7, "a.txt", "same  text"), (2, 8, "b.txt", " same text ")]))
    writers.append_chunks(first, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    row = stored.collect()
    assert len(row) == 1 and row[0].session_id == 8 and row[0].source_name == "a"
    later = upload(spark, [(3, 9, "c.txt", "same text"), (4, 9, "d.txt", "new"), (5, 9, "e", " ")])
    added, moved = ingest(later, stored)
    assert [r.content for r in added.collect()] == ["new"]
    assert [r.session_id for r in moved.collect()] == [9]


def test_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "01234567-89ab-cdef-0123-456789abcdef_my notes.txt").write_text("a\nb\n")
    row = readers.text_files(spark, str(tmp_path)).first()
    assert (row.file_name, row.text) == ("my notes.txt", "a\nb\n")


def test_scan_pushes_its_predicate(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as d", "id as unused").write.parquet(str(tmp_path / "t"))
    scanned = readers.scan(spark, str(tmp_path / "t"), F.col("id") > 7, ["d"])
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,7)" in plan and "unused" not in plan
    assert sorted(r.d for r in scanned.collect()) == [16, 18]


def test_upsert_prefers_new_versions(spark):
    layout = "vector_id string, version int, text string"
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept")], layout)
    new = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", 1, "added")], layout)
    rows = {r.vector_id: r.text for r in writers.upsert(old, new).collect()}
    assert rows == {"a": "new", "b": "kept", "c": "added"}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session())
