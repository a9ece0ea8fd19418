"""Schemas of tables and records."""

from __future__ import annotations

SOURCES = "id long, name string, url string, adapter string, enabled boolean, created_at timestamp"
JOB_ADS = (
    "id long, source_id long, source_url string, title string, company string, salary string, description string, "
    "posted_at timestamp, scraped_at timestamp, status string"
)
PROFILE = "key string, value string"
LETTERS = "id long, job_ad_id long, content string, model string, created_at timestamp"
STATE = "stream string, last_update_id long"
PAGES = "page_id long, source_id long, page_no int, requested_url string, final_url string, http_status int, body string"
AD = "source_url string, title string, company string, salary string, description string, posted_at timestamp"
UPDATE = "update_id long, message struct<message_id: long, text: string, chat: struct<id: long>>"
STATUSES = ("new", "applied", "rejected", "ignored")
ADAPTERS = ("static", "jobstreet", "glints", "dealls", "kalibrr", "threads", "telegram")
