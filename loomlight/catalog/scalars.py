"""Projections, filters and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.catalog import tables as t
from loomlight.catalog.registry import query
from loomlight.functions import images, intent, prompts, text
from loomlight.operators import evidence as ev
from loomlight.operators import sessions as se

TRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'"


@query(
    "P1",
    sql="""
    SELECT doc_id, lower(source || ' ' || lang || ' v' || (doc_id % 3)) AS source_name
    FROM documents""",
)
def normalize_source_name(spark, folder):
    docs = t.documents(spark, folder)
    version = (F.col("doc_id") % 3).cast("string")
    name = F.concat(F.upper("source"), F.lit("_"), "lang", F.lit("-v"), version, F.lit(".tar.gz"))
    without = F.regexp_replace(name, r"\.tar", "")
    return docs.select("doc_id", text.normalize_source_name(without).alias("source_name"))


@query("P2", sql=f"WITH {t.UPLOADS_SQL} SELECT doc_id, content_hash FROM uploads")
def content_hash(spark, folder):
    docs = t.documents(spark, folder)
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(
    "P3",
    sql="""
    SELECT page_id, regexp_replace(url, '^.*/', '') AS file_name FROM pages""",
)
def strip_upload_prefix(spark, folder):
    """Page addresses stored under an id prefix, which is taken off again."""
    digest = F.md5("html")
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    stored = F.concat(F.concat_ws("-", *parts), F.lit("_"), F.substring_index("url", "/", -1))
    return t.table(spark, folder, "pages").select(
        "page_id", text.strip_upload_prefix(stored).alias("file_name")
    )


@query(
    "P4",
    sql=rf"""
    WITH {t.SESSIONS_SQL}, s AS (
      SELECT session_id,
        regexp_replace(regexp_replace(regexp_replace(
          CASE WHEN regexp_matches(title, '\S') THEN title ELSE 'session' END,
          '[^a-zA-Z0-9\-_ ]', '', 'g'), {TRIM}), '\s+', '-', 'g') AS slug
      FROM sessions)
    SELECT session_id,
           CASE WHEN slug = '' THEN 'session-' || session_id ELSE slug END || '.pdf' AS file_name
    FROM s""",
)
def export_file_name(spark, folder):
    return t.sessions(spark, folder).select(
        "session_id",
        text.export_file_name(F.col("title"), F.col("session_id")).alias("file_name"),
    )


@query(
    "P5",
    sql="""
    SELECT page_id, url_decode(replace(regexp_replace(url, '^.*/', ''), '+', ' ')) AS title,
           'https://wiki.example/' ||
             replace(url_decode(replace(regexp_replace(url, '^.*/', ''), '+', ' ')), ' ', '_')
             AS page_url
    FROM pages""",
)
def page_title_and_url(spark, folder):
    title = text.page_title(F.col("url"))
    return t.table(spark, folder, "pages").select(
        "page_id",
        title.alias("title"),
        text.page_url(title, "https://wiki.example/").alias("page_url"),
    )


@query(
    "P6",
    sql=f"""
    WITH {t.UPLOADS_SQL}, {t.QUESTIONS_SQL}
    SELECT doc_id, source_name FROM uploads
    WHERE source_name IN (SELECT target FROM questions WHERE target IS NOT NULL)""",
)
def source_filter(spark, folder):
    """Uploads of the sources that questions name."""
    wanted = (
        t.questions(spark, folder)
        .select(F.explode("target_documents").alias("name"))
        .select(text.normalize_source_name(F.col("name")).alias("source_name"))
        .distinct()
    )
    named = t.uploads(spark, folder).select(
        "doc_id", t.source_name_of("file_name").alias("source_name")
    )
    return named.join(wanted, "source_name", "left_semi")


@query(
    "P7",
    sql=f"""
    WITH {t.UPLOADS_SQL}
    SELECT doc_id, source_type IN ('IMAGE', 'PDF_IMAGE') AS in_dense,
           image_url IS NOT NULL AND image_url <> '' AS in_lexical
    FROM files WHERE source_type IN ('IMAGE', 'PDF_IMAGE') OR image_url IS NOT NULL""",
)
def image_only_filter(spark, folder):
    dense = F.col("source_type").isin("IMAGE", "PDF_IMAGE")
    lexical = ~text.is_blank(F.col("image_url"))
    return (
        t.uploads(spark, folder)
        .filter(dense | F.col("image_url").isNotNull())
        .select("doc_id", dense.alias("in_dense"), lexical.alias("in_lexical"))
    )


EXCHANGES_SQL = f"""
    WITH {t.MESSAGES_SQL}, exchanges AS (
      SELECT u.message_id, u.session_id, u.content AS question, a.content AS answer,
             (length(a.content) % 10) / 10.0 AS top_score
      FROM messages u LEFT JOIN messages a
        ON a.session_id = u.session_id AND a.turn = u.turn + 1 AND a.role = 'ASSISTANT'
      WHERE u.role = 'USER'),
    gated AS (
      SELECT *, coalesce(
          len(regexp_split_to_array(regexp_replace(question, '\\s+$', ''), '\\s+')) >= 4
          AND NOT contains(answer, 'I couldn''t find relevant information')
          AND NOT contains(answer, 'I apologize')
          AND NOT contains(answer, 'I currently have no information')
          AND NOT regexp_matches(lower(question),
            'what did i say|our chat|what are your capabilities|who are you|what can you do|what are you'),
          false) AS memorable
      FROM exchanges)"""


def exchanges(spark, folder):
    """Each user message with the assistant's next turn; scores come from answer lengths."""
    said = t.messages(spark, folder)
    answers = said.filter("role = 'ASSISTANT'").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("answer")
    )
    return (
        said.filter("role = 'USER'")
        .join(answers, ["session_id", "turn"], "left")
        .select(
            "message_id",
            "session_id",
            F.col("content").alias("question"),
            "answer",
            ((F.length("answer") % 10) / 10.0).alias("top_score"),
            "created_at",
        )
    )


@query(
    "P8",
    sql=EXCHANGES_SQL
    + "SELECT message_id, memorable, memorable AND coalesce(top_score, 0) >= 0.4 AS remembered "
    "FROM gated",
)
def memory_gate(spark, folder):
    rows = exchanges(spark, folder)
    question, answer = F.col("question"), F.col("answer")
    return rows.select(
        "message_id",
        intent.is_memorable(question, answer).alias("memorable"),
        intent.is_remembered(question, answer, F.col("top_score")).alias("remembered"),
    )


# A lead-in chosen by the turn gives every rule of the classifier something to decide.
LEADS = ["", "hi ", "what did i upload ", "what have we ", "who are you ", "ok", "earlier you said "]
LEAD_SQL = "CASE turn % 7 " + " ".join(
    f"WHEN {i} THEN '{lead}'" for i, lead in enumerate(LEADS)
) + " END"


@query(
    "P9",
    sql=rf"""
    WITH q AS (
      SELECT conv_id, turn, regexp_replace(lower({LEAD_SQL} ||
        CASE WHEN turn % 7 = 5 THEN '' WHEN turn % 7 = 1 THEN split_part(text, ' ', 1)
             ELSE text END), {TRIM}) AS q
      FROM conversations)
    SELECT conv_id, turn, CASE
      WHEN q IN ('hi','hello','hey','thanks','thank you','ok','okay','clear history','bye',
                 'good morning','good evening')
        OR (len(regexp_split_to_array(regexp_replace(q, '\s+$', ''), '\s+')) <= 3
            AND (starts_with(q, 'hi ') OR starts_with(q, 'hello ') OR starts_with(q, 'hey ')))
        THEN 'GREETING_ACK'
      WHEN starts_with(q, 'what did i upload') OR regexp_matches(q,
        'what files|what documents did i upload|how many files|how many uploaded files|my uploaded files')
        THEN 'SESSION_INFO'
      WHEN starts_with(q, 'what did i') OR starts_with(q, 'what have we')
        OR contains(q, 'what did i ask') OR (contains(q, 'earlier') AND contains(q, 'said'))
        THEN 'META_HISTORY'
      WHEN regexp_matches(q, 'what are your|who are you|what can you do|what all you can do|what all can you do|what can u do|what do you do|what are you capable|your capabilities|your features|how can you help|how do you help|what are you')
        THEN 'BOT_QA' END AS intent
    FROM q""",
)
def fast_intent(spark, folder):
    said = t.table(spark, folder, "conversations")
    turn = F.col("turn") % 7
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), (turn + 1).cast("int"))
    body = (
        F.when(turn == 5, "")
        .when(turn == 1, F.split("text", " ")[0])
        .otherwise(F.col("text"))
    )
    clean = intent.clean_query(F.concat(lead, body))
    return said.select("conv_id", "turn", intent.fast_intent(clean).alias("intent"))


@query(
    "P10",
    sql=rf"""
    WITH {t.UPLOADS_SQL}, m AS (
      SELECT conv_id, turn, regexp_replace(lower(text), {TRIM}) AS q FROM conversations)
    SELECT conv_id, turn, CASE
      WHEN turn = 7 THEN 'NONE'
      WHEN regexp_matches(q,
        '\A[^\n\r]*\b(this|that|the|given|uploaded|attached|above|provided)\b[^\n\r]*\z')
        AND conv_id IN (SELECT session_id FROM uploads) THEN 'SPECIFIC_DOC'
      ELSE 'CORPUS' END AS scope
    FROM m""",
)
def retrieval_scope(spark, folder):
    """Scope of every message; the eighth turn stands for a question about the assistant."""
    said = t.table(spark, folder, "conversations")
    with_uploads = (
        t.uploads(spark, folder).select(F.col("session_id").alias("conv_id")).distinct()
    ).withColumn("uploads", F.lit(True))
    clean = intent.clean_query(F.col("text"))
    scope = intent.retrieval_scope(clean, F.col("uploads"), F.col("turn") == 7)
    return said.join(with_uploads, "conv_id", "left").select("conv_id", "turn", scope.alias("scope"))


def raw_answers(spark, folder):
    """Raw routing answers wrapped in prose, one per message; some are broken."""
    said = t.table(spark, folder, "conversations")
    words = F.split("text", r"\s+")
    plan = F.struct(
        F.lit("find").alias("purpose"),
        F.array_join(words, " ").alias("optimized_query"),
        F.transform(words, lambda w: F.concat(w, F.lit(".pdf"))).alias("target_documents"),
    )
    payload = F.to_json(
        F.struct(
            F.lit("SINGLE_SOURCE").alias("strategy"),
            (F.col("turn") % 5 == 4).alias("is_bot_qa"),
            F.when(F.col("turn") % 3 == 0, "decompose").alias("execution_tier"),
            F.when(F.col("turn") % 2 == 0, "union").otherwise("merge").alias("merge_operation"),
            F.when(F.col("turn") % 4 == 3, F.array().cast("array<struct<purpose:string>>"))
            .otherwise(F.array(plan.dropFields("optimized_query", "target_documents")))
            .alias("unused"),
            F.transform(
                F.sequence(F.lit(1), (F.col("turn") % 3).cast("int") + 1), lambda _: plan
            ).alias("plans"),
        )
    )
    broken = F.col("turn") == 6
    return said.select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.when(broken, F.concat(F.lit("sorry {"), "text"))
        .otherwise(F.concat(F.lit("Sure, here it is: "), payload, F.lit(" as asked.")))
        .alias("raw"),
    )


@query(
    "P11",
    sql=r"""
    WITH w AS (
      SELECT conv_id, turn, text, regexp_split_to_array(text, '\s+') AS words FROM conversations)
    SELECT conv_id, turn, 'SINGLE_SOURCE' AS strategy,
      CASE WHEN turn = 6 THEN 'DIRECT' WHEN turn % 3 = 0 THEN 'decompose' END AS tier,
      CASE WHEN turn = 6 THEN 1 ELSE turn % 3 + 1 END AS plans,
      CASE WHEN turn = 6 THEN text ELSE array_to_string(words, ' ') END AS first_query,
      CASE WHEN turn = 6 THEN ''
        ELSE array_to_string(list_transform(words, lambda x: x || '.pdf'), ',') END AS first_targets
    FROM w""",
)
def parse_routing(spark, folder):
    parsed = intent.parse_routing(F.col("raw"), F.col("question"))
    rows = raw_answers(spark, folder).withColumn("routing", parsed)
    first = F.element_at("routing.plans", 1)
    return rows.select(
        "conv_id",
        "turn",
        F.col("routing.strategy").alias("strategy"),
        F.col("routing.execution_tier").alias("tier"),
        F.size("routing.plans").cast("bigint").alias("plans"),
        first["optimized_query"].alias("first_query"),
        F.array_join(first["target_documents"], ",").alias("first_targets"),
    )


@query(
    "P13",
    sql="""
    SELECT conv_id, turn,
      CASE WHEN turn = 3 THEN 'STOP' WHEN role = 'user' THEN 'SEARCH' ELSE 'STOP' END AS type,
      CASE WHEN turn = 3 THEN 'Parse failed, stopping' ELSE role END AS reasoning,
      CASE WHEN turn <> 3 AND role = 'user' THEN text END AS next_query
    FROM conversations""",
)
def parse_next_action(spark, folder):
    """Raw next-step answers built from messages; the fourth turn names an unknown step."""
    kind = F.when(F.col("turn") == 3, "WANDER").when(F.col("role") == "user", "SEARCH")
    payload = F.to_json(
        F.struct(
            F.coalesce(kind, F.lit("STOP")).alias("type"),
            F.col("role").alias("reasoning"),
            F.col("text").alias("next_query"),
        )
    )
    raw = F.concat(F.lit("Next:\n"), payload, F.lit("\nDone."))
    return (
        t.table(spark, folder, "conversations")
        .select("conv_id", "turn", intent.parse_next_action(raw).alias("action"))
        .select("conv_id", "turn", "action.*")
    )


ANCHORED_SQL = f"""
    WITH {t.ATTACHMENTS_SQL}, {t.MESSAGES_SQL}, anchored AS (
      SELECT session_id, message_id, role, content, created_at FROM messages
      UNION ALL
      SELECT session_id, -1 - attachment_id, 'USER', '[file upload: ' || file_name || ']',
             uploaded_at FROM attachments)"""


def anchored_messages(spark, folder):
    """Messages together with the anchor message every upload leaves in its session."""
    said = t.messages(spark, folder).select(
        "session_id", "message_id", "role", "content", "created_at"
    )
    anchors = t.attachments(spark, folder).select(
        "session_id",
        (-1 - F.col("attachment_id")).alias("message_id"),
        F.lit("USER").alias("role"),
        F.concat(F.lit("[file upload: "), "file_name", F.lit("]")).alias("content"),
        F.col("uploaded_at").alias("created_at"),
    )
    return said.unionByName(anchors)


@query(
    "P14",
    sql=ANCHORED_SQL
    + """
    SELECT session_id, message_id, starts_with(content, '[file upload:')
        OR starts_with(content, '[wikipedia link:') AS is_anchor FROM anchored""",
)
def upload_anchor(spark, folder):
    return anchored_messages(spark, folder).select(
        "session_id", "message_id", text.is_upload_anchor(F.col("content")).alias("is_anchor")
    )


# Messages with citation markers put after their first word and at their end.
MARKED_SQL = r"""marked AS (
  SELECT conv_id * 1000 + turn AS message_id, text,
    regexp_replace(text, '^(\S*)', '\1 [CITE: 1, ' || (turn + 2) || ']')
      || CASE WHEN turn % 2 = 0 THEN ' ```code [CITE: 9]``` [cite: 2]' ELSE ' [CITE:3]' END
      AS content
  FROM conversations)"""


def marked_messages(spark, folder):
    said = t.table(spark, folder, "conversations")
    first = F.concat(F.lit("$1 [CITE: 1, "), (F.col("turn") + 2).cast("string"), F.lit("]"))
    tail = F.when(F.col("turn") % 2 == 0, " ```code [CITE: 9]``` [cite: 2]").otherwise(" [CITE:3]")
    return said.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        "text",
        "turn",
        F.concat(F.regexp_replace("text", F.lit(r"^(\S*)"), first), tail).alias("content"),
    )


@query(
    "P15",
    sql=rf"WITH {MARKED_SQL} SELECT message_id, "
    r"regexp_replace(content, '\[CITE:\s*[\d,\s]+\]', '', 'g') AS content FROM marked",
)
def strip_citation_markers(spark, folder):
    return marked_messages(spark, folder).select(
        "message_id", text.strip_citation_markers(F.col("content")).alias("content")
    )


@query(
    "P16",
    sql=rf"""
    WITH {MARKED_SQL}, g AS (
      SELECT message_id, unnest(regexp_extract_all(
        regexp_replace(content, '(?s)```.*?```', ' ', 'g'),
        '(?i)\[CITE:\s*([\d,\s]+)\]', 1)) AS ids FROM marked),
    n AS (SELECT message_id, trim(unnest(string_split(ids, ','))) AS id FROM g)
    SELECT message_id, id::BIGINT AS cited_no FROM n WHERE id <> ''""",
)
def citation_markers(spark, folder):
    return ev.citation_markers(marked_messages(spark, folder), "message_id", "content")


@query(
    "P16",
    sql=r"""
    SELECT conv_id * 1000 + turn AS message_id,
      regexp_replace(text, '^(\S*)', '\1 [1](#cite-1) [' || (turn + 2) || '](#cite-'
        || (turn + 2) || ')')
      || CASE WHEN turn % 2 = 0 THEN ' ```code [CITE: 9]``` [2](#cite-2)' ELSE ' [3](#cite-3)' END
      AS content
    FROM conversations""",
)
def citation_links(spark, folder):
    return marked_messages(spark, folder).select(
        "message_id", ev.linked_citations(F.col("content")).alias("content")
    )


@query(
    "P17",
    sql=rf"""
    WITH lines AS (
      SELECT doc_id, list_transform(regexp_split_to_array('- ' || text, '\r?\n'),
        lambda x: regexp_replace(regexp_replace(x, '^[\s\-*•\d.)"'']+', ''), {TRIM})) AS l
      FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x: regexp_matches(x, '\S'))[1:3], '|')
      AS questions FROM lines""",
)
def question_lines(spark, folder):
    raw = F.concat(F.lit("- "), F.col("text"))
    return t.documents(spark, folder).select(
        "doc_id", F.array_join(text.question_lines(raw), "|").alias("questions")
    )


IMAGE_SQL = r"""
    WITH d AS (
      SELECT doc_id, lang, source, text, regexp_split_to_array(text, '\s+') AS w,
             'A detailed diagram showing ' || text || '. More.' AS summary
      FROM documents),
    i AS (
      SELECT doc_id, source, regexp_replace(array_to_string(list_filter([
          CASE WHEN lang <> 'en' THEN '[Image Type: ' || lang || ']' END,
          '[Summary: ' || summary || ']',
          '[Objects: ' || array_to_string(w, ', ') || ']',
          CASE WHEN len(w) > 1 THEN '[Relationships: ' || array_to_string(
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '; ') || ']' END,
          '[Keywords: ' || source || ', ' || lang || ']'], lambda x: x IS NOT NULL), chr(10)),
          '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS caption
      FROM d)"""


def described_images(spark, folder):
    """An image description made of each document."""
    docs = t.documents(spark, folder)
    words = F.split("text", r"\s+")
    none = F.array().cast("array<string>")
    summary = F.concat(F.lit("A detailed diagram showing "), "text", F.lit(". More."))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1),
        F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    image = F.struct(
        summary.alias("summary"),
        F.array("source", "lang").alias("keywords"),
        none.alias("technologies"),
        words.alias("objects"),
        F.when(F.size(words) > 1, pairs).otherwise(none).alias("relationships"),
        F.lit(" ").alias("ocr"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("image_type"),
    )
    return docs.select("doc_id", "source", images.dense_image_text(image).alias("caption"))


@query("P18", sql=IMAGE_SQL + "SELECT doc_id, caption FROM i")
def dense_image_text(spark, folder):
    return described_images(spark, folder).select("doc_id", "caption")


@query(
    "P19",
    sql=IMAGE_SQL
    + r"""
    , s AS (
      SELECT doc_id, source, regexp_replace(split_part(regexp_replace(
        regexp_extract(caption, '\[Summary: (.*?)\]', 1), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'),
        '.', 1),
        '^(?i)(A|The|This) (detailed |descriptive )?(diagram|image|chart|screenshot|photo) (showing|of|illustrating|comparing) ',
        '') AS subject FROM i),
    c AS (
      SELECT doc_id, source, CASE WHEN length(subject) > 60
             THEN substr(subject, 1, 60) || '...' ELSE subject END AS cut FROM s)
    SELECT doc_id, CASE WHEN cut = '' THEN 'Image from ' || source
      ELSE upper(substr(cut, 1, 1)) || substr(cut, 2) END AS title FROM c""",
)
def visual_title(spark, folder):
    return described_images(spark, folder).select(
        "doc_id", images.visual_title(F.col("caption"), F.col("source")).alias("title")
    )


@query(
    "P21",
    sql="SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations",
)
def token_estimate(spark, folder):
    return t.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens")
    )


@query(
    "P22",
    sql="""
    SELECT doc_id, md5(substr(text, 1, 12000)) AS question_context,
      md5(substr(text, 1, 18000)) AS summary_context,
      CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 40) || '…' END AS title
    FROM documents""",
)
def bounded_text(spark, folder):
    body = F.col("text")
    return t.documents(spark, folder).select(
        "doc_id",
        F.md5(text.bounded(body, text.QUESTION_CONTEXT_CHARS)).alias("question_context"),
        F.md5(text.bounded(body, text.SUMMARY_CONTEXT_CHARS)).alias("summary_context"),
        text.short_title(body).alias("title"),
    )


@query(
    "P23",
    sql="""
    SELECT doc_id, substr(text, 1, 200) || '…' AS excerpt,
      floor((CASE WHEN doc_id % 5 = 0 THEN 1.0::DOUBLE / (1 + doc_id % 17)
                  ELSE (n_chars % 997) / 997.0::DOUBLE END) * 1000.0::DOUBLE + 0.5::DOUBLE)
        / 1000.0::DOUBLE AS score
    FROM documents""",
)
def excerpt_and_score(spark, folder):
    final = F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise((F.col("n_chars") % 997) / 997.0)
    semantic = F.lit(1.0) / (1 + F.col("doc_id") % 17)
    # A final score of zero outside the fifth documents falls back in both.
    safe = F.when((final == 0.0) & (F.col("doc_id") % 5 != 0), F.lit(0.0)).otherwise(semantic)
    return t.documents(spark, folder).select(
        "doc_id",
        text.excerpt(F.col("text")).alias("excerpt"),
        text.citation_score(final, safe).alias("score"),
    )


HEADED_SQL = r"""headed AS (
  SELECT doc_id, source AS page, text,
    CASE WHEN doc_id % 2 = 0 THEN text END AS h2,
    CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS h3,
    CASE WHEN doc_id % 5 = 0 THEN lang END AS h4
  FROM documents),
pathed AS (
  SELECT *, CASE WHEN h2 IS NULL AND h3 IS NULL AND h4 IS NULL THEN 'Lead'
            ELSE concat_ws(' > ', h2, h3, h4) END AS section_path FROM headed)"""


def headed_documents(spark, folder):
    doc = F.col("doc_id")
    return t.documents(spark, folder).select(
        "doc_id",
        F.col("source").alias("page"),
        "text",
        F.when(doc % 2 == 0, F.col("text")).alias("h2"),
        F.when(doc % 3 == 0, F.md5("text")).alias("h3"),
        F.when(doc % 5 == 0, F.col("lang")).alias("h4"),
    )


@query("P24", sql=f"WITH {HEADED_SQL} SELECT doc_id, section_path FROM pathed")
def section_path(spark, folder):
    path = text.section_path(F.col("h2"), F.col("h3"), F.col("h4"))
    return headed_documents(spark, folder).select("doc_id", path.alias("section_path"))


@query(
    "P25",
    sql=f"""WITH {HEADED_SQL}
    SELECT doc_id, 'Page: ' || page || chr(10) || 'Section: ' || section_path || chr(10)
      || chr(10) || text AS content FROM pathed""",
)
def section_content(spark, folder):
    path = text.section_path(F.col("h2"), F.col("h3"), F.col("h4"))
    return headed_documents(spark, folder).select(
        "doc_id", text.section_content(F.col("page"), path, F.col("text")).alias("content")
    )


GROUNDED = "Use the sources only.\n<inferenceDirective>\nEnd."
GENERAL = "Answer from general knowledge."
SEARCH_DIRECTIVE = "List the documents that fit."
# Every strategy, one that is not known, and what each adds to the prompt.
STRATEGIES = {
    **prompts.DIRECTIVES,
    "META_DOC_SEARCH": SEARCH_DIRECTIVE,
    "SINGLE_SOURCE": prompts.LITERAL_DIRECTIVE,
    "NO_SUCH_STRATEGY": prompts.LITERAL_DIRECTIVE,
}


@query(
    "P26",
    sql=rf"""
    WITH q AS (SELECT item_id, text, item_id % 3 = 0 AS bare FROM benchmark)
    SELECT item_id,
      'Context Information:' || chr(10) || CASE WHEN bare THEN '' ELSE 'Facts: ' || text END
        || chr(10) || chr(10)
        || CASE WHEN item_id % 2 = 0 THEN 'Runtime Session Context:' || chr(10)
             || 'Uploaded Files:' || chr(10) || '- a.pdf' || chr(10) || '- b.pdf' || chr(10)
             || CASE WHEN item_id % 4 = 0
                     THEN 'Currently Active File in UI: a.pdf' || chr(10) ELSE '' END
           ELSE '' END
        || chr(10) || 'Conversation History:' || chr(10)
        || CASE WHEN bare THEN '' ELSE lower(text) END
        || chr(10) || chr(10) || 'User Question:' || chr(10) || text AS prompt,
      CASE WHEN bare THEN 'Answer from general knowledge.'
           ELSE 'Use the sources only.' || chr(10) || CASE item_id % {len(STRATEGIES)}
             {" ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(STRATEGIES.values()))} END
             || chr(10) || 'End.' END AS system
    FROM q""",
)
def prompt_assembly(spark, folder):
    item = F.col("item_id")
    bare = item % 3 == 0
    strategies = F.array(*[F.lit(name) for name in STRATEGIES])
    files = F.when(item % 2 == 0, F.array(F.lit("a.pdf"), F.lit("b.pdf"))).otherwise(
        F.array().cast("array<string>")
    )
    active = F.when(item % 4 == 0, F.lit("a.pdf"))
    history = F.when(bare, "").otherwise(F.lower("text"))
    context = F.when(bare, "").otherwise(F.concat(F.lit("Facts: "), F.col("text")))
    return t.table(spark, folder, "benchmark").select(
        "item_id",
        prompts.user_prompt(
            F.col("text"), context, history, prompts.session_block(files, active)
        ).alias("prompt"),
        prompts.system_prompt(
            bare, F.get(strategies, (item % len(STRATEGIES)).cast("int")), history, GROUNDED, GENERAL, SEARCH_DIRECTIVE
        ).alias("system"),
    )


PREFERENCES_SQL = r"""preferences AS (
  SELECT c_custkey AS user_id,
    CASE c_custkey % 5 WHEN 0 THEN 'Hindi' WHEN 1 THEN ' fr ' WHEN 2 THEN 'klingon'
                       WHEN 3 THEN 'DE' END AS language,
    CASE c_custkey % 3 WHEN 0 THEN 'CONCISE' WHEN 1 THEN 'TECHNICAL' END AS response_style,
    CASE c_custkey % 2 WHEN 0 THEN 'GEMINI_2_5_PRO' ELSE 'GEMINI_2_5_FLASH_LITE' END AS model_name,
    CASE c_custkey % 4 WHEN 0 THEN 'GEMINI_3_1_FLASH_LITE' WHEN 1 THEN 'NO_SUCH_MODEL'
                       WHEN 2 THEN ' ' END AS override
  FROM customer)"""


def preferences(spark, folder):
    """Preferences and a requested model for every customer."""
    key = F.col("c_custkey")
    return t.table(spark, folder, "customer").select(
        key.alias("user_id"),
        F.when(key % 5 == 0, "Hindi")
        .when(key % 5 == 1, " fr ")
        .when(key % 5 == 2, "klingon")
        .when(key % 5 == 3, "DE")
        .alias("language"),
        F.when(key % 3 == 0, "CONCISE").when(key % 3 == 1, "TECHNICAL").alias("response_style"),
        F.when(key % 2 == 0, "GEMINI_2_5_PRO")
        .otherwise("GEMINI_2_5_FLASH_LITE")
        .alias("model_name"),
        F.when(key % 4 == 0, "GEMINI_3_1_FLASH_LITE")
        .when(key % 4 == 1, "NO_SUCH_MODEL")
        .when(key % 4 == 2, " ")
        .alias("override"),
    )


@query(
    "P27",
    sql=f"""
    WITH {PREFERENCES_SQL}
    SELECT user_id,
      CASE WHEN override = 'GEMINI_3_1_FLASH_LITE' THEN 'gemini-3.1-flash-lite'
           WHEN model_name = 'GEMINI_2_5_PRO' THEN 'gemini-2.5-pro'
           ELSE 'gemini-2.5-flash-lite' END AS model,
      CASE user_id % 5 WHEN 0 THEN 'Hindi (हिंदी)' WHEN 1 THEN 'French (Français)'
                       WHEN 3 THEN 'German (Deutsch)' ELSE 'English' END AS language,
      length('Base' ||
        CASE response_style
          WHEN 'CONCISE' THEN chr(10) || chr(10) || 'CRITICAL INSTRUCTION: Provide a brief, direct, and concise response without fluff or unnecessary details.'
          WHEN 'TECHNICAL' THEN chr(10) || chr(10) || 'CRITICAL INSTRUCTION: Provide a highly technical, precise, and professional response, using appropriate terminology.'
          ELSE '' END) AS styled_length
    FROM preferences""",
)
def preference_resolution(spark, folder):
    rows = preferences(spark, folder)
    styled = prompts.styled_prompt(F.lit("Base"), F.col("response_style"), F.lit("en"))
    return rows.select(
        "user_id",
        prompts.requested_model(F.col("override"), F.col("model_name")).alias("model"),
        prompts.language_name(F.col("language")).alias("language"),
        F.length(styled).cast("bigint").alias("styled_length"),
    )


@query(
    "P27",
    sql=f"""
    WITH {PREFERENCES_SQL}
    SELECT user_id, coalesce(language, 'en') AS language, 'light' AS theme,
      CASE WHEN user_id % 2 = 0 THEN 'DETAILED' ELSE coalesce(response_style, 'BEGINNER') END
        AS response_style, model_name,
      CASE WHEN user_id % 2 = 0 THEN 0.2 ELSE 0.7 END::DOUBLE AS temperature
    FROM preferences""",
)
def preference_update(spark, folder):
    """All users name a model that does not exist; every second one changes style and temperature."""
    stored = preferences(spark, folder).select(
        "user_id",
        F.lit(None).cast("string").alias("theme"),
        "language",
        F.lit(None).cast("boolean").alias("citation_enabled"),
        "response_style",
        "model_name",
        F.lit(None).cast("double").alias("temperature"),
    )
    even = F.col("user_id") % 2 == 0
    changes = stored.select(
        "user_id",
        F.lit(None).cast("string").alias("theme"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("boolean").alias("citation_enabled"),
        F.when(even, "detailed").alias("response_style"),
        F.lit("nothing").alias("model_name"),
        F.when(even, 0.2).alias("temperature"),
    )
    return prompts.update_preferences(stored, changes).drop("citation_enabled")


@query(
    "P28",
    sql=f"""
    WITH {t.ATTACHMENTS_SQL}
    SELECT attachment_id, file_name FROM attachments
    WHERE contains(lower(file_name), 'rc1_') OR contains(lower(url), 'rc1_')""",
)
def substring_search(spark, folder):
    found = text.contains_text("RC1_", F.col("file_name"), F.col("url"))
    return t.attachments(spark, folder).filter(found).select("attachment_id", "file_name")


@query(
    "P29",
    sql="""
    SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE 1 END AS citations,
      CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS excerpt,
      CASE WHEN turn % 4 = 3 THEN NULL ELSE turn / 8.0::DOUBLE END AS score
    FROM conversations""",
)
def stored_lists(spark, folder):
    """Citation lists stored as JSON text; every fourth is cut off and gives null."""
    entry = F.struct(
        F.lit("src").alias("sourceName"),
        F.col("text").alias("excerpt"),
        (F.col("turn") / 8.0).alias("score"),
    )
    stored = F.to_json(F.array(entry))
    cut = F.when(F.col("turn") % 4 == 3, F.substring(stored, 1, 9)).otherwise(stored)
    rows = t.table(spark, folder, "conversations").select(
        "conv_id", "turn", cut.alias("citations_json"), F.lit("").alias("visuals_json")
    )
    first = F.get("citations", F.lit(0))
    return ev.parse_citations(rows).select(
        "conv_id",
        "turn",
        F.when(F.col("citations").isNotNull(), F.size("citations")).cast("int").alias("citations"),
        first["excerpt"].alias("excerpt"),
        first["score"].alias("score"),
    )


WORDS_SQL = r"""list_filter(list_distinct(regexp_split_to_array(lower({0}), '\W+')),
                            lambda x: length(x) > 2)"""


@query(
    "P30",
    sql=f"""
    SELECT doc_id, len(w) AS words, array_to_string(list_sort(w), ' ') AS word_set
    FROM (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents)""",
)
def word_set(spark, folder):
    words = text.word_set(F.col("text"))
    return t.documents(spark, folder).select(
        "doc_id",
        F.size(words).cast("bigint").alias("words"),
        F.array_join(F.array_sort(words), " ").alias("word_set"),
    )


@query(
    "P31",
    sql=f"""
    WITH w AS (SELECT conv_id, turn, {WORDS_SQL.format("text")} AS w FROM conversations)
    SELECT a.conv_id, a.turn,
      round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0::DOUBLE
           ELSE len(list_intersect(a.w, b.w))::DOUBLE
             / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS similarity
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def jaccard(spark, folder):
    """Likeness of each message and the next one of its session."""
    words = t.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.word_set(F.col("text")).alias("words")
    )
    following = words.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words")
    )
    likeness = text.jaccard(F.col("words"), F.col("next_words"))
    return words.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(likeness, 6).alias("similarity")
    )


@query(
    "P32",
    sql="SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
)
def display_timestamp(spark, folder):
    return t.table(spark, folder, "events").select(
        "event_id", text.display_timestamp(F.col("ts")).alias("shown")
    )


@query(
    "P33",
    "W10",
    sql=rf"""
    WITH p AS (
      SELECT conv_id, turn, text,
        lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after
      FROM conversations)
    SELECT conv_id, turn, 'Source: Enterprise Document (PDF)' || chr(10)
      || CASE WHEN regexp_matches(before, '\S') THEN chr(10) || '--- PREVIOUS SECTION ---'
           || chr(10) || regexp_replace(before, {TRIM}) ELSE '' END
      || CASE WHEN regexp_matches(text, '\S') THEN chr(10) || '--- CURRENT SECTION ---'
           || chr(10) || regexp_replace(text, {TRIM}) ELSE '' END
      || CASE WHEN regexp_matches(after, '\S') THEN chr(10) || '--- NEXT SECTION ---'
           || chr(10) || regexp_replace(after, {TRIM}) ELSE '' END AS context
    FROM p""",
)
def neighbour_pages(spark, folder):
    """Turns as pages of one document per conversation."""
    pages = t.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    context = images.paged_image_context(
        F.col("previous_text"), F.col("current_text"), F.col("next_text")
    )
    return se.neighbour_texts(pages, "conv_id", "turn", "text").select(
        "conv_id", "turn", context.alias("context")
    )


@query(
    "P34",
    sql="""
    SELECT event_id, round((1.0 / (1.0 + exp(-(value - 20) / 10)))::FLOAT::DOUBLE, 5) AS score
    FROM events""",
)
def sigmoid_score(spark, folder):
    score = text.sigmoid_score((F.col("value") - 20) / 10).cast("double")
    return t.table(spark, folder, "events").select("event_id", F.round(score, 5).alias("score"))


@query(
    "P35",
    sql="""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp'
           ELSE 'image/jpeg' END AS mime FROM pages""",
)
def image_mime(spark, folder):
    suffix = F.element_at(
        F.array(F.lit(".PNG"), F.lit(".webp"), F.lit(".gif")), (F.col("page_id") % 3 + 1).cast("int")
    )
    return t.table(spark, folder, "pages").select(
        "page_id", text.image_mime(F.concat("url", suffix)).alias("mime")
    )
