"""The library's functions as temporary SQL functions: scalar ones, and table functions for LATERAL.

The bodies are SQL, so a query that calls them is planned as if it were written out; patterns and
lists come from the modules that define them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyloom import schemas
from tallyloom.functions import predicates as P
from tallyloom.functions import scalars as S
from tallyloom.functions import sqltext as Q
from tallyloom.functions.predicates import DATE_SHARD, DML, TEMPORARY
from tallyloom.operators.assets import NO_VISUALIZATION
from tallyloom.operators.catalog import ROW_SAMPLE

WIDGETS = schemas.DASHBOARDS.split(" widgets ")[1]


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values) -> str:
    return ", ".join(_quote(v) for v in values)


def register_functions(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session."""
    def define(signature: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")

    comments = _quote(Q.LITERAL_OR_COMMENT)
    text = f"lower(regexp_replace(q, {comments}, '$1 '))"
    text = f"regexp_replace({text}, {_quote(Q.SPACES)}, ' ')"
    text = f"regexp_replace({text}, {_quote(Q.AROUND_SIGNS)}, '')"
    text = f"trim(regexp_replace({text}, {_quote(Q.TAIL)}, ''))"
    define("canonical_query(q STRING)", "STRING", text)
    define("query_shape(q STRING)", "STRING",
           f"array_join(transform(split(regexp_replace(canonical_query(q), {_quote(Q.QUOTED)}, '?'), "
           f"'`'), (p, i) -> if(i % 2 = 1, p, regexp_replace(p, {_quote(Q.NUMBER)}, '?'))), '`')")
    define("query_shape_id(q STRING)", "STRING",
           "sha2(coalesce(nullif(query_shape(coalesce(q, '')), ''), coalesce(q, '')), 256)")
    define("raw_complexity(joins BIGINT, ctes BIGINT, windows BIGINT, subqueries BIGINT, grouped BOOLEAN)",
           "BIGINT", "joins + 2 * ctes + 3 * windows + subqueries + cast(grouped AS BIGINT)")
    define("is_temporary_write(d STRING)", "BOOLEAN",
           f"coalesce(lower(d) RLIKE {_quote(TEMPORARY)}, false)")
    define("is_service_account(e STRING)", "BOOLEAN",
           "coalesce(lower(e) LIKE '%.iam.gserviceaccount.com', false)")
    define("is_dml(k STRING)", "BOOLEAN",
           f"coalesce(upper(k) RLIKE {_quote(DML)}, false)")
    define("logical_table_name(n STRING)", "STRING",
           f"regexp_replace(n, {_quote(DATE_SHARD)}, '')")
    _define_texts(define)
    _define_scores(define)
    _define_repositories(define)
    _define_tables(define, text)


def _define_scores(define) -> None:
    """Dates, decay and shares, and the scores made of them."""
    define("parse_iso(t STRING)", "TIMESTAMP",
           f"CASE WHEN t RLIKE {_quote(S._FULL_DATE)} THEN try_to_timestamp(t) END")
    define("parse_due(t STRING)", "TIMESTAMP",
           f"CASE WHEN t RLIKE {_quote(S._DATE_ONLY)} THEN try_to_timestamp(concat(t, ' 23:59:59')) "
           "ELSE parse_iso(t) END")
    define("elapsed_days(as_of TIMESTAMP, t TIMESTAMP)", "DOUBLE",
           f"(unix_micros(as_of) - unix_micros(t)) / {float(S.MICROS_PER_SECOND * S.SECONDS_PER_DAY)}D")
    define("elapsed_hours(as_of TIMESTAMP, t TIMESTAMP)", "DOUBLE",
           f"(unix_micros(as_of) - unix_micros(t)) / {3_600.0 * S.MICROS_PER_SECOND}D")
    define("decay(days DOUBLE, rate DOUBLE, weight DOUBLE DEFAULT 1.0D)", "DOUBLE",
           "coalesce(weight * exp(-rate * days), 0D)")
    define("log_share(n DOUBLE, largest DOUBLE)", "DOUBLE",
           "coalesce(log1p(n) / nullif(log1p(largest), 0D), 0D)")
    define("due_urgency(as_of TIMESTAMP, due STRING)", "DOUBLE",
           "CASE WHEN floor(-elapsed_days(as_of, parse_due(due))) < 0 THEN 1D "
           "WHEN floor(-elapsed_days(as_of, parse_due(due))) <= 7 THEN 0.5D ELSE 0D END")
    define("query_impact(dashboards BIGINT, charts BIGINT, most_dashboards BIGINT, most_charts BIGINT)", "DOUBLE",
           "6 * (0.8D * log_share(dashboards, most_dashboards) + 0.2D * log_share(charts, most_charts))")
    define("query_recency(as_of TIMESTAMP, updated_at STRING)", "DOUBLE",
           "decay(elapsed_days(as_of, parse_iso(updated_at)), 0.02D, 3D)")
    define("query_curation(description STRING, schedule STRING)", "DOUBLE",
           "if(is_present(description), 0.5D, 0D) + if(is_present_json(schedule), 0.5D, 0D)")
    define("dashboard_recency(as_of TIMESTAMP, updated_at STRING)", "DOUBLE",
           "decay(elapsed_days(as_of, parse_iso(updated_at)), 0.01D, 2D)")
    define("task_timeliness(as_of TIMESTAMP, due STRING, modified_at STRING)", "DOUBLE",
           "due_urgency(as_of, due) + decay(floor(elapsed_days(as_of, parse_iso(modified_at))), 0.02D)")


def _define_texts(define) -> None:
    """Tests of texts, ids, states and metrics."""
    define("is_present(t STRING)", "BOOLEAN", "coalesce(t, '') <> ''")
    define("is_present_json(t STRING)", "BOOLEAN",
           """is_present(t) AND trim(t) NOT IN ('{}', '[]', 'null', 'false', '0', '""')""")
    define("is_present_id(i STRING)", "BOOLEAN", "i IS NOT NULL AND i NOT IN ('', '0')")
    define("shorten(t STRING, n INT)", "STRING",
           "CASE WHEN length(t) > n THEN concat(substring(t, 1, n), '...') ELSE t END")
    define("is_date_text(t STRING)", "BOOLEAN",
           f"coalesce(t RLIKE {_quote(f'^{Q.DATE_TEXT}$')}, false)")
    define("card_kind(k STRING)", "STRING",
           "CASE lower(k) WHEN 'model' THEN 'models' WHEN 'metric' THEN 'metrics' ELSE 'cards' END")
    define("status_label(state STRING, pr_url STRING)", "STRING",
           "CASE WHEN state = 'done' AND pr_url IS NOT NULL THEN 'COMPLETED' WHEN state = 'running' "
           "THEN 'PROCESSING' WHEN state = 'failed' THEN 'FAILED' ELSE 'QUEUED' END")
    define("progress_of(status STRING)", "INT",
           "coalesce(try_cast(split_part(status, ':', 2) AS INT), 0)")
    define("is_exportable_metric(m STRING)", "BOOLEAN", "coalesce(m RLIKE "
           + _quote(f"^(?:gcp_.*|{'|'.join(P.ALLOWED_METRICS)})$") + ", false)")
    define("safe_labels(labels MAP<STRING, STRING>)", "MAP<STRING, STRING>",
           f"map_filter(labels, (k, v) -> k NOT IN ({_listed(P.SENSITIVE_LABELS)}))")


def _define_repositories(define) -> None:
    """Rules of repositories, pull requests and files."""
    define("is_valid_pull_request(id STRING, title STRING, link STRING, author STRING, head STRING, base STRING)",
           "BOOLEAN", " AND ".join(f"is_present({c})" for c in ("id", "title", "link", "author", "head", "base")))
    define("is_valid_repository(name STRING, full_name STRING, link STRING)", "BOOLEAN",
           "is_present(name) AND is_present(full_name) AND is_present(link)")
    define("repository_key(slug STRING, name STRING, full_name STRING)", "STRING",
           "coalesce(nullif(slug, ''), nullif(name, ''), nullif(element_at(split(full_name, '/'), -1), ''))")
    define("is_countable_file(kind STRING, path STRING, size BIGINT, max_bytes BIGINT DEFAULT NULL)", "BOOLEAN",
           "coalesce(kind = 'blob' AND is_present(path) AND if(max_bytes IS NULL, size IS NOT NULL, "
           f"size <= max_bytes) AND NOT path RLIKE {_quote(P.GIT_FOLDER)}, false)")
    define("file_extension(path STRING)", "STRING", f"lower(regexp_extract(path, {_quote(P.FILE_ENDING)}, 1))")
    define("looks_like_text(content BINARY)", "BOOLEAN",
           "coalesce(instr(decode(content, 'ISO-8859-1'), chr(0)) = 0 AND (length(content) - length("
           f"regexp_replace(decode(content, 'ISO-8859-1'), {_quote(P.PRINTABLE)}, ''))) "
           f"/ greatest(length(content), 1) > {P.TEXT_PRINTABLE_SHARE}D, false)")
    define("is_probably_text(path STRING, content BINARY)", "BOOLEAN",
           f"file_extension(path) IN ({_listed(P.TEXT_EXTENSIONS)}) OR looks_like_text(content)")


def _define_tables(define, canonical: str) -> None:
    """Table functions: a row each for the widgets of a dashboard, the rows of a card's result, and
    the parts of a signature that a query's marks tell without their order."""
    define("widget_kind(has_visualization BOOLEAN, viz_type STRING)", "STRING",
           f"if(has_visualization, coalesce(viz_type, 'unknown_type'), {_quote(NO_VISUALIZATION)})")
    define(f"dashboard_widgets(id BIGINT, widgets {WIDGETS})",
           "TABLE(dashboard_id BIGINT, pos BIGINT, widget_id BIGINT, has_visualization BOOLEAN, viz_type STRING, "
           "query_id BIGINT, text STRING, `row` INT, col INT)",
           # The condition stands in the generator: a filter over it would make Spark join the rows to themselves.
           "SELECT id, cast(p AS BIGINT), w.id, w.visualization IS NOT NULL, w.visualization.type, "
           "w.visualization.query.id, w.text, coalesce(w.options.position.row, 0), "
           "coalesce(w.options.position.col, 0) FROM LATERAL posexplode("
           "if(id IS NOT NULL AND cast(id AS STRING) NOT IN ('', '0'), widgets, NULL)) AS e(p, w)")
    listed = ("filter(sequence(1, size(names)), i -> NOT array_contains(slice(names, i + 1, "
              "greatest(size(names) - i, 0)), element_at(names, i)))")
    listed = f"if(size(names) > 0, {listed}, cast(array() AS ARRAY<INT>))"
    define("result_row(names ARRAY<STRING>, r STRING)", "MAP<STRING, STRING>",
           f"CASE WHEN r RLIKE {_quote(P.JSON_LIST)} THEN map_from_arrays("
           f"transform({listed}, i -> element_at(names, i)), "
           f"transform({listed}, i -> try_element_at(from_json(r, 'array<string>'), i))) "
           f"WHEN r RLIKE {_quote(P.JSON_OBJECT)} THEN from_json(r, 'map<string,string>') "
           "ELSE map('_value', r) END")
    define(f"result_rows(names ARRAY<STRING>, found ARRAY<STRING>, n INT DEFAULT {ROW_SAMPLE})",
           "TABLE(row_number INT, fields MAP<STRING, STRING>)",
           "SELECT p + 1, result_row(names, r) FROM LATERAL posexplode(slice(found, 1, n)) AS e(p, r)")
    dated = f"regexp_replace({canonical}, {_quote(f"('{Q.DATE_TEXT}')|{Q.QUOTED}")}, '$1?')"
    plain = f"regexp_replace({dated}, {_quote(Q._SIGNS)}, '')"
    listed = Q._TOLD + "".join(groups + Q._ENDS for groups in Q._FIELDS.values())
    define("query_marks(q STRING)", "ARRAY<ARRAY<STRING>>",
           f"transform(slice(split(regexp_replace({plain}, {_quote(Q._MARK)}, {_quote(listed)}), "
           f"{_quote(Q._TOLD)}), 2, {1 << 30}), m -> split(m, {_quote(Q._ENDS)}))")
    # No SQL function can be called in a generator: the marks are written out.
    marks = f"regexp_replace({plain}, {_quote(Q._MARK)}, {_quote(Q._CUT)})"
    aggregates = (f"sort_array(array_distinct(transform(regexp_extract_all(m, {_quote(Q.AGGREGATE)}, 1), "
                  "a -> rtrim(translate(a, '(', ' ')))))")
    operators = (f"sort_array(transform(regexp_extract_all(m, {_quote(Q.SET_OPERATOR)}, 1), "
                 "o -> upper(replace(o, ' distinct', ''))))")
    limit, order = f"contains(m, {_quote(Q.LIMIT)})", f"contains(m, {_quote(Q.ORDER_BY)})"
    for name, kind, body in (("aggregate_functions", "ARRAY<STRING>", aggregates), ("has_limit", "BOOLEAN", limit),
                             ("set_operators", "ARRAY<STRING>", operators), ("has_order_by", "BOOLEAN", order)):
        define(f"{name}(q STRING)", kind, f"get(transform(array({marks}), m -> {body}), 0)")
    # The marks are found once, inside the generator: over a sub-query of the text, Spark would join the
    # texts to themselves.
    define("signature_parts(q STRING)", "TABLE(part STRING, value STRING)",
           "SELECT part, value FROM LATERAL explode(get(transform("
           f"array({marks}), m -> map("
           f"'agg_funcs', array_join({aggregates}, ','), 'set_ops', array_join({operators}, ','), "
           f"'has_limit', cast({limit} AS STRING), 'has_order_by', cast({order} AS STRING))), 0)) AS e(part, value)")
