"""Column layouts of the domain tables, as Spark DDL."""

CHUNKS = (
    "vector_id string, session_id bigint, content string, source_name string, "
    "source_type string, content_hash string, original_file_name string, "
    "enriched_file_name string, asset_classification string, asset_tags string, "
    "chunk_index int, total_chunks int, image_url string, source_url string, "
    "created_at timestamp_ntz"
)
ATTACHMENTS = (
    "attachment_id bigint, user_id bigint, session_id bigint, type string, file_name string, "
    "storage_path string, url string, mime_type string, file_size_bytes bigint, "
    "uploaded_at timestamp_ntz, metadata map<string,string>"
)
VIEW_ATTACHMENTS = "id bigint, session_id bigint, attachment_id bigint, added_at timestamp_ntz"
SESSIONS = (
    "session_id bigint, user_id bigint, title string, archived boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
MESSAGES = (
    "message_id bigint, session_id bigint, role string, content string, status string, "
    "created_at timestamp_ntz, citations_json string, visuals_json string"
)
PREFERENCES = (
    "user_id bigint, theme string, language string, citation_enabled boolean, "
    "response_style string, model_name string, temperature double"
)
ANALYTICS_DAILY = (
    "date date, unique_visitors bigint, chat_requests bigint, documents_uploaded bigint, "
    "pdf_exports bigint, tokens_generated bigint, avg_response_ms double, response_count bigint"
)
INGESTION_PAYLOAD = (
    "jobId bigint, sourceType string, sourceLocation string, sessionId bigint, userId bigint, "
    "sourceUrl string"
)
CHAT_RECORD = (
    "messageId string, sessionId string, query string, model string, timestamp string"
)
EXPORT_RECORD = "jobId string, sessionId string, userEmail string, timestamp string"
TOKEN_EVENT = "message_id bigint, seq bigint, event string, data string, ts timestamp"
PROGRESS = (
    "id string, stage string, status string, message string, iteration int, "
    "totalIterations int, metadata map<string,string>, timestamp string"
)
SCOPE_EXPANSION = "type string, `from` string, `to` string, reason string"

# Names of the enumerated columns.
ATTACHMENT_TYPES = ["PDF", "IMAGE", "TEXT", "WIKIPEDIA", "OTHER"]
SOURCE_TYPES = ["PDF", "DOCX", "WIKIPEDIA", "HTML", "MARKDOWN", "TEXT", "IMAGE", "OTHER"]
JOB_STATUSES = ["QUEUED", "PROCESSING", "FAILED", "COMPLETED"]
MESSAGE_STATUSES = ["PROCESSING", "COMPLETED", "FAILED", "CANCELLED"]
MERGE_OPERATIONS = ["NONE", "UNION", "COMPARE"]
SCOPES = ["NONE", "SPECIFIC_DOC", "CORPUS"]
UPLOAD_STATES = ["UPLOADING", "EMBEDDING", "INGESTING", "READY", "FAILED"]
