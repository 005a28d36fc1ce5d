"""Row predicates and small projections over metadata columns."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.scalars import present

TEXT_PRINTABLE_SHARE = 0.9
PRINTABLE = r"[\x20-\x7E\t\r\n]"
GIT_FOLDER = r"(^|/)\.git/"
FILE_ENDING = r"\.([A-Za-z0-9]+)(?:\.(?:gz|bz2|xz|br|Z))?$"
JSON_LIST, JSON_OBJECT = r"^\s*\[", r"^\s*\{"

# File name endings whose built-in media type is text, JSON or XML.
TEXT_EXTENSIONS = sorted(
    ending.lstrip(".") for ending, kind in mimetypes.MimeTypes().types_map[True].items()
    if kind.startswith("text/") or kind in ("application/json", "application/xml"))

# Fixed value: the date part of a sharded table name (_YYYYMMDD, _YYYY_MM_DD or _YYYYMM).
DATE_SHARD = r"_\d{4}(?:_?\d{2}){1,2}$"

# Marks of temporary destinations, and statement types that write.
TEMPORARY = "_temp_|_tmp_|scratch|temp_"
DML = "INSERT|MERGE|UPDATE|DELETE|CREATE_TABLE_AS_SELECT"

# Metrics that may leave the cluster, and labels that must not.
ALLOWED_METRICS = (
    "task_requests_total", "postgres_writes_success_total", "redis_writes_success_total",
    "gcs_uploads_success_total", "pubsub_messages_success_total", "elastic_index_success_total",
)
SENSITIVE_LABELS = ("customer_id", "project_name", "user_email", "tenant_id")


def qualified_name(table: Column) -> Column:
    """``project.dataset.table`` of a table reference struct; null stays null."""
    return F.when(table.isNotNull(), F.concat_ws(
        ".", table["project_id"], table["dataset_id"], table["table_id"]))


def is_temporary_write(destination: Column) -> Column:
    return F.coalesce(F.lower(destination).rlike(TEMPORARY), F.lit(False))


def is_service_account(email: Column) -> Column:
    return F.coalesce(email.rlike(r"(?i)\.iam\.gserviceaccount\.com$"), F.lit(False))


def has_persistent_destination(destination: Column, temporary: Column) -> Column:
    return present(destination) & ~temporary


def is_dml(statement_type: Column) -> Column:
    return F.coalesce(statement_type.rlike(f"(?i){DML}"), F.lit(False))


def logical_table_name(name: Column) -> Column:
    """Table name without a date-shard suffix."""
    return F.regexp_replace(name, DATE_SHARD, "")


def _all_present(*columns: Column) -> Column:
    verdict = F.lit(True)
    for column in columns:
        verdict = verdict & present(column.cast("string"))
    return verdict


def is_valid_pull_request(identifier: Column, title: Column, link: Column, author: Column,
                          head: Column, base: Column) -> Column:
    """Both hosts ask for the same six parts: id, title, link, author, source, target."""
    return _all_present(identifier, title, link, author, head, base)


def is_valid_repository(name: Column, full_name: Column, link: Column) -> Column:
    return _all_present(name, full_name, link)


def is_countable_file(kind: Column, path: Column, size: Column,
                      max_bytes: int | None = None) -> Column:
    """A blob with a path and a size, outside any ``.git`` folder; of at most ``max_bytes`` when
    that is given."""
    inside_git = path.rlike(GIT_FOLDER)
    sized = size.isNotNull() if max_bytes is None else size <= max_bytes
    return F.coalesce((kind == "blob") & present(path) & sized & ~inside_git, F.lit(False))


def file_extension(path: Column) -> Column:
    """Ending of the file name in lower case; that of a packed file is the one before."""
    return F.lower(F.regexp_extract(path, FILE_ENDING, 1))


def looks_like_text(content: Column, probe_bytes: int | None = None) -> Column:
    """Text test on the whole content, or on its first ``probe_bytes``: no NUL and more than
    90 % printable.

    Each byte is one Latin-1 character, so lengths count bytes.
    """
    probe = content if probe_bytes is None else F.substring(content, 1, probe_bytes)
    chars = F.decode(probe, "ISO-8859-1")
    odd = F.regexp_replace(chars, PRINTABLE, "")
    total = F.length(chars)
    share = (total - F.length(odd)) / F.greatest(total, F.lit(1))
    return F.coalesce((F.instr(chars, "\x00") == 0) & (share > TEXT_PRINTABLE_SHARE), F.lit(False))


def is_probably_text(path: Column, content: Column, probe_bytes: int | None = None) -> Column:
    return file_extension(path).isin(*TEXT_EXTENSIONS) | looks_like_text(content, probe_bytes)


def repository_key(slug: Column, name: Column, full_name: Column) -> Column:
    """Slug, else name, else the last part of the full name; null when all are missing."""
    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))
    return F.coalesce(given(slug), given(name), given(F.element_at(F.split(full_name, "/"), -1)))


def card_kind(card_type: Column) -> Column:
    kind = F.lower(card_type)
    return F.when(kind == "model", "models").when(kind == "metric", "metrics").otherwise("cards")


def is_exportable_metric(metric: Column) -> Column:
    names = "|".join(ALLOWED_METRICS)
    return F.coalesce(metric.rlike(f"^(?:gcp_.*|{names})$"), F.lit(False))


def safe_labels(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*SENSITIVE_LABELS))


def person_name(user: Column, creator: Column) -> Column:
    """Name of the user, else of the creator when no user is given, else ``Unknown``."""
    return F.coalesce(F.when(user.isNotNull(), user["name"]).otherwise(creator["name"]),
                      F.lit("Unknown"))


def status_label(state: Column, pr_url: Column) -> Column:
    return (F.when((state == "done") & pr_url.isNotNull(), "COMPLETED")
             .when(state == "running", "PROCESSING")
             .when(state == "failed", "FAILED")
             .otherwise("QUEUED"))


def progress_of(status: Column) -> Column:
    """Number in ``RUNNING:<n>``; 0 for anything else."""
    return F.coalesce(F.split_part(status, F.lit(":"), F.lit(2)).try_cast("int"), F.lit(0))
