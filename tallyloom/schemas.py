"""Schemas of the domain tables, as DDL text; readers never infer."""

from __future__ import annotations

TABLE_REF = "struct<project_id:string,dataset_id:string,table_id:string>"
PERSON = "struct<name:string>"


JOBS = (
    "user_email string, query string, creation_time timestamp, start_time timestamp, "
    "end_time timestamp, statement_type string, "
    f"referenced_tables array<{TABLE_REF}>, destination_table {TABLE_REF}, job_id string, "
    "region string, project_id string, job_type string, state string")

PHYSICAL_TABLES = "region string, table_schema string, table_name string"
DATASETS = "dataset_id string, location string"

DASHBOARDS = (
    "id long, name string, slug string, created_at string, updated_at string, "
    f"user {PERSON}, created_by {PERSON}, is_draft boolean, tags array<string>, "
    "widgets array<struct<id:long,text:string,"
    "options:struct<position:struct<row:int,col:int,sizeX:int,sizeY:int>>,"
    "visualization:struct<type:string,query:struct<id:long>>>>")

SAVED_QUERIES = (
    "id long, name string, description string, query string, created_at string, "
    f"updated_at string, schedule string, user {PERSON}, created_by {PERSON}")

TASKS = (
    "gid string, name string, permalink_url string, completed boolean, due_on string, "
    f"due_at string, modified_at string, assignee {PERSON}, assignee_status string, "
    "workspace_id string, project_data struct<gid:string,name:string>, "
    "dependencies array<struct<gid:string>>, dependents array<struct<gid:string>>, "
    "followers array<struct<gid:string>>, "
    "custom_fields array<struct<name:string,display_value:string,text_value:string,"
    "number_value:double>>")

SUBTASKS = "parent_gid string, child_gid string"
STORIES = "task_gid string, gid string, type string, text string, created_at string"

REPOS = (
    "org string, name string, slug string, full_name string, default_branch string, size long, "
    "fork boolean, private boolean, archived boolean, html_url string")
REPO_FILES = "org string, repo string, type string, path string, size long"
PULL_REQUESTS = (
    "org string, repo string, id long, title string, html_url string, author string, "
    "head string, base string")
COMMITS = "org string, repo string, sha string"

CARDS = "id long, type string, name string"
CARD_RESULTS = "card_id long, cols array<string>, rows array<array<string>>"
DUMP_LINE = "artifact string, kind string, id long, data string"

DAG_LOGS = (
    "timestamp timestamp, severity string, payload string, log_name string, "
    "resource_type string, resource_labels map<string,string>, dag_id string")
RAW_LOG_ENTRIES = (
    "timestamp timestamp, severity string, text_payload string, "
    "json_payload map<string,string>, log_name string, resource_type string, "
    "resource_labels map<string,string>, dag_id string")

METRICS = "metric string, labels map<string,string>, ts timestamp, value double"

TASK_EVENTS = "task_id string, ts timestamp, type string, field string, value string"
TASK_EVENT_BODY = (
    "type string, stage string, status string, n int, doc_id string, version string, "
    "feedback string, steps int, progress int")
FEEDBACK = "id string, document_id string, body string, created_at timestamp"
FEATURE_VIEW_REQUEST = (
    "feature_registry_source struct<feature_groups:array<struct<feature_group_id:string,"
    "feature_ids:array<string>>>>, sync_config struct<cron:string>")
