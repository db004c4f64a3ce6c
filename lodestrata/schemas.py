"""Schemas of the engine's tables."""

CHUNKS = "symbol_id string, file_path string, language string, kind string, content string, start_line int, end_line int"
EDGES = "src string, dst string, relation string, usage_modes array<string>"
SYMBOLS = "symbol_id string, short_name string, file_path string, kind string"
VECTORS = "symbol_id string, file_path string, content string, embedding array<double>"
VOTES = "symbol_id string, query_text string, vote int, original_score double, reason string, created_at timestamp"
PATTERNS = "query_text string, symbol_id string, score double, boosted boolean, created_at timestamp"
AI_FEEDBACK = "feedback_id string, client_id string, pr_context string, n_tools int, n_mentions int, rating int, suggestions string, expected string, symbol_id string, helpful boolean, status string, score double, created_at timestamp, consumed_at timestamp, consumed_by string"
BUILDS = "repo string, build_id string, parent_id string, status string, quality_score double, chunk_count long, created_at timestamp"
INCIDENTS = "session_id string, event_id string, event_type string, state string, payload string, created_at timestamp"
EVAL_CASES = "case_id string, fingerprint string, expected_root_cause string, expected_patch string, environment string, tags array<string>, created_at timestamp"
THREADS = "thread_id string, op string, message_id string, role string, title string, content string, citations string, created_at timestamp"
RESOLVED = "fingerprint string, root_cause string, patch string, created_at timestamp"
