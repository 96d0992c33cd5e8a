"""Schemas of the stored entities, as DDL."""

from __future__ import annotations

LOCATION = "struct<kind:string,path:string,span:struct<start:bigint,end:bigint>,schema:string,payload:string>"

CHUNK = (
    f"id string, text string, items array<string>, summary string, keywords array<string>, facts array<string>, pending array<string>, parent string, children array<string>, metadata map<string,string>, "
    f"last_active_at timestamp, order_in_parent bigint, source_location {LOCATION}, summary_level int, summary_method string, edited_by_user boolean, auto_update_locked boolean"
)
FACT = "id string, key string, value string, scope struct<kind:string,chunk:string>, origin string, superseded_by string, created_at timestamp"
PENDING = "id string, text string, introduced_at string, expected_resolution string, resolved_at string, priority string, created_at timestamp"
ENTITIES = {"chunk": CHUNK, "fact": FACT, "pending": PENDING}

#: Priorities in rising order. Fixed values.
PRIORITIES = ("Low", "Medium", "High")

CASE = "case_id string, correct boolean, latency_ms bigint, prompt_tokens int, completion_tokens int, retrieval_latency_ms bigint, retrieved_chunks bigint, retrieval_chars bigint, compressed_chars bigint"
SESSIONS = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
QUESTIONS = "context string, questions array<string>, answers array<array<string>>, metadata string"
LABELLED = "text string, label string"
