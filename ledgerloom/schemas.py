"""Explicit schemas of the tables between stages."""

from __future__ import annotations

COMPANIES = "company string, ticker string, cik string, universe_snapshot_date date, fiscal_year_end string, n_10k int, n_10q int"
MANIFEST = (
    "filing_id string, company string, ticker string, cik string, form_type string, filing_date date, period_of_report date, "
    "accession_number string, primary_document string, is_inline_xbrl boolean, document_url string, local_path string"
)
SUBMISSIONS = "filings struct<recent: struct<form: array<string>, filingDate: array<string>, reportDate: array<string>, accessionNumber: array<string>, primaryDocument: array<string>>, files: array<struct<name: string>>>"
STATE = "id string, status string, attempts bigint, updated_at timestamp, error string, bytes bigint"
SPANS = "trace string, span string, parent string, name string, kind string, start timestamp, end timestamp, input string, ms double"
QUESTIONS = "qid string, type string, question string, facts array<struct<row_label:string,value:string,prior_value:string>>, answer_values array<string>, expected_change double, expected_pct double, gold_groups array<array<string>>, ticker string"
RANKED = "query_id string, node_id string, score double, rank bigint"
