"""The nineteen tables as Spark DDL; identifiers are derived, times are UTC."""

from __future__ import annotations

_TIMES = "created_at TIMESTAMP, updated_at TIMESTAMP"
TABLES: dict[str, str] = {
    "locations": f"id BIGINT, kind STRING, name STRING, name_key STRING, official_id STRING, province_id BIGINT, county_id BIGINT, area_codes ARRAY<STRING>, lat DOUBLE, lon DOUBLE, dataset_version STRING, is_synthetic BOOLEAN, {_TIMES}",
    "categories": "code STRING, name_fa STRING, terms ARRAY<STRUCT<term: STRING, weight: DOUBLE>>, role_terms ARRAY<STRUCT<term: STRING, weight: DOUBLE>>, negative_terms ARRAY<STRUCT<term: STRING, weight: DOUBLE>>, enabled BOOLEAN",
    "sources": f"id BIGINT, key STRING, name STRING, kind STRING, base_url STRING, reliability DOUBLE, requires_key BOOLEAN, official BOOLEAN, enabled BOOLEAN, last_status STRING, success_count BIGINT, error_count BIGINT, blocked_until TIMESTAMP, config STRING, {_TIMES}",
    "businesses": f"id BIGINT, fingerprint STRING, name STRING, name_key STRING, owner_name STRING, address STRING, province_id BIGINT, county_id BIGINT, city_id BIGINT, province_name STRING, county_name STRING, city_name STRING, website STRING, domain STRING, social_links ARRAY<STRING>, business_type STRING, categories ARRAY<STRING>, primary_category STRING, relevance_score INT, relevance_evidence STRING, confidence INT, confidence_band STRING, confidence_breakdown STRING, source_count BIGINT, independent_source_count BIGINT, status STRING, merged_into BIGINT, is_synthetic BOOLEAN, field_status MAP<STRING, STRING>, description STRING, discovered_at TIMESTAMP, last_seen_at TIMESTAMP, last_validated_at TIMESTAMP, discovered_by_query BIGINT, discovered_by_job BIGINT, {_TIMES}",
    "phones": f"id BIGINT, e164 STRING, national STRING, digits STRING, type STRING, area_code STRING, subscriber STRING, status STRING, confidence INT, confidence_band STRING, is_synthetic BOOLEAN, invalid_reason STRING, fake_signals ARRAY<STRING>, source_count BIGINT, validation_count BIGINT, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, last_validated_at TIMESTAMP, next_check_at TIMESTAMP, {_TIMES}",
    "business_phones": "id BIGINT, business_id BIGINT, phone_id BIGINT, is_primary BOOLEAN, label STRING, confidence INT, status STRING, source_count BIGINT, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP",
    "source_observations": "id BIGINT, dedupe_hash STRING, business_id BIGINT, phone_id BIGINT, source_id BIGINT, evidence_kind STRING, url STRING, url_hash STRING, url_domain STRING, page_title STRING, snippet STRING, extracted STRING, confidence_hint INT, source_reliability DOUBLE, status STRING, observed_at TIMESTAMP, query_id BIGINT, job_id BIGINT",
    "validation_results": "id BIGINT, phone_id BIGINT, business_id BIGINT, method STRING, result STRING, band STRING, confidence INT, breakdown STRING, signals STRING, notes STRING, checked_at TIMESTAMP",
    "validation_history": "id BIGINT, phone_id BIGINT, previous_band STRING, new_band STRING, previous_status STRING, new_status STRING, previous_confidence INT, new_confidence INT, changed BOOLEAN, reason STRING, created_at TIMESTAMP",
    "search_jobs": f"id BIGINT, kind STRING, name STRING, status STRING, params STRING, target BIGINT, progress DOUBLE, cancel_requested BOOLEAN, counters MAP<STRING, BIGINT>, heartbeat_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP, error STRING, {_TIMES}",
    "search_queries": f"id BIGINT, source_key STRING, query_hash STRING, query_text STRING, province STRING, county STRING, city STRING, category STRING, business_type STRING, state STRING, depth INT, max_depth INT, run_count INT, results_seen BIGINT, new_results BIGINT, failures INT, last_run_at TIMESTAMP, next_run_at TIMESTAMP, {_TIMES}",
    "query_history": "id BIGINT, query_id BIGINT, job_id BIGINT, page INT, results BIGINT, new_results BIGINT, status STRING, error STRING, duration_ms BIGINT, created_at TIMESTAMP",
    "job_events": "id BIGINT, job_id BIGINT, level STRING, event STRING, message STRING, data STRING, created_at TIMESTAMP",
    "queue_items": f"id BIGINT, kind STRING, dedupe_key STRING, payload STRING, state STRING, priority INT, attempts INT, max_attempts INT, available_at TIMESTAMP, leased_until TIMESTAMP, worker STRING, error STRING, {_TIMES}",
    "http_cache": "url_hash STRING, url STRING, status INT, content_type STRING, body BINARY, fetched_at TIMESTAMP, expires_at TIMESTAMP",
    "duplicate_log": "id BIGINT, canonical_id BIGINT, merged_id BIGINT, score DOUBLE, reasons ARRAY<STRING>, created_at TIMESTAMP",
    "export_records": "id BIGINT, path STRING, format STRING, filters STRING, row_count BIGINT, created_at TIMESTAMP",
    "app_settings": "key STRING, value STRING, updated_at TIMESTAMP",
    "schema_version": "version STRING, applied_at TIMESTAMP",
}


def empty(spark, name: str):
    return spark.createDataFrame([], TABLES[name])
