"""Fixed schemas: the seven fact tables, documents and the capture command."""

# Identifiers are strings; the ledger derives them with SHA-256 from their natural keys.
FACTS = {
    "sources": (
        "source_id string, owner_id string, original_url string, normalized_url string, "
        "canonical_url string, host string, classification string, created_at timestamp"
    ),
    "inbox": (
        "command_id string, subject string, command_type string, producer string, "
        "received_at timestamp, applied_at timestamp, outcome string"
    ),
    "runs": (
        "run_id string, command_id string, operation_id string, owner_id string, "
        "correlation_id string, source_id string, status string, policy_version string, "
        "normalizer_version string, parser_version string, document_id string, "
        "queued_at timestamp, started_at timestamp, completed_at timestamp, "
        "last_error_class string, claimed_until timestamp, claimed_by string"
    ),
    "fetches": (
        "fetch_id string, run_id string, final_url string, http_status int, media_type string, "
        "wire_bytes bigint, decoded_bytes bigint, attempts int, cache_outcome string, etag string, "
        "last_modified string, fetched_at timestamp"
    ),
    "artifacts": (
        "artifact_id string, run_id string, kind string, owner_service string, "
        "digest_algorithm string, digest_hex string, media_type string, length_bytes bigint, "
        "created_at timestamp"
    ),
    "candidates": (
        "candidate_id string, run_id string, strategy string, extractor_version string, "
        "metrics struct<text_characters:int,paragraph_count:int,text_volume:int,"
        "paragraph_distribution:int,non_link_share:int,non_boilerplate_share:int,"
        "title_agreement:int,accepted:boolean>, score double, reasons array<string>, "
        "selected boolean, artifact_id string, created_at timestamp"
    ),
    "outbox": (
        "outbox_id string, message_id string, causation_command_id string, operation_id string, "
        "subject string, payload string, enqueued_at timestamp, next_attempt_at timestamp, "
        "attempts int, claimed_until timestamp, claimed_by string, published_at timestamp, "
        "dead_lettered_at timestamp, last_error string"
    ),
}

# Natural keys and the columns that keep their first value when a fact is written again.
FACT_KEYS = {
    "sources": (["owner_id", "normalized_url"], None),
    "fetches": (["run_id"], ["fetch_id", "fetched_at"]),
    "artifacts": (["run_id", "kind"], ["artifact_id", "created_at"]),
    "candidates": (
        ["run_id", "strategy", "extractor_version"], ["candidate_id", "created_at"],
    ),
}

PAGES = "page_id bigint, url string, html string"
BLOCKS = "array<struct<kind:string,level:int,text:string>>"
COMMAND = (
    "command_id string, command_type string, requested_at string, operation_id string, "
    "tenant_id string, correlation_id string, idempotency_key string, payload struct<url:string>"
)
# Column names that would mean a raw body leaked into a fact table.
FORBIDDEN_FACT_COLUMNS = ("body", "bytes", "content", "path", "payload", "raw_bytes")
