"""Tables of the postings engine."""

from __future__ import annotations

RAW_POSTING = (
    "source string, external_id string, title string, company_name string, description_html string, url string, "
    "posted_at_ms bigint, location_raw string, salary_min double, salary_max double, salary_currency string"
)
POSTING = (
    "posting_id bigint, source string, external_id string, title string, company_name string, url string, posted_at_ms bigint, "
    "location_raw string, salary_min double, salary_max double, salary_currency string, description_raw string, "
    "description_clean string, remote_claim string, employment_type string, fingerprint string, first_seen_at_ms bigint"
)
POSTING_VECTOR = "posting_id bigint, model string, dim int, vec array<double>"
# what a batch looks up of those before it
FINGERPRINT = "fingerprint string, posting_id bigint"
COMPANY_VECTOR = "key string, posting_id bigint, vec array<double>"
COMPANY_KEY = "key string"
REPOST = "canonical_id bigint, seen_at_ms bigint, n bigint"
COUNTER = "name string, value bigint"
DUPLICATE_LINK = "posting_id bigint, canonical_id bigint, similarity double"
RULE_RESULT = "struct<rule_id:int,rule_name:string,kind:string,validator:string,verdict:string,evidence:string>"
EVALUATION = f"posting_id bigint, outcome string, results array<{RULE_RESULT}>"
FACTOR = "struct<name:string,label:string,score:double,weight:double,evidence:string>"
FLAG = "struct<type:string,severity:string,evidence:array<string>,explanation:string>"
INGEST_RUN = "run_id string, source string, status string, fetched bigint, added bigint, duplicates bigint, error string, started_at_ms bigint"
