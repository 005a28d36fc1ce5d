"""The same results in SQL for DuckDB, written independently of the operators.

Query-log expectations are derived from the parameters that the texts were built from, not
by pattern matching on the texts.
"""

from __future__ import annotations

from tallyloom.plans.adapters import (EVENTS_AS_OF, HASH_FIELD, HASH_VALUE, HIGH, HIGH_OLD, LOG_STATE,
                                      LOW, ORDERS_AS_OF, OTHER_TEXT, QUERY_TEXT, STAGE, USER_EMAIL)

TS = "'%Y-%m-%d %H:%M:%S.%f'"
E_AS_OF = f"TIMESTAMP '{EVENTS_AS_OF}'"
O_AS_OF = f"TIMESTAMP '{ORDERS_AS_OF}'"

CTES = {
    "widgets": """SELECT l_orderkey + 1 AS dashboard_id,
  l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS pos,
  l_orderkey || '-' || l_linenumber AS widget_id, l_partkey + 1 AS query_id,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'no_visualization'
       WHEN l_returnflag = 'N' THEN 'text' ELSE 'chart' END AS kind,
  CASE WHEN l_linestatus = 'F' THEN '' ELSE 'note' END AS note,
  l_linenumber AS grid_row, l_suppkey % 3 AS grid_col FROM lineitem""",
    "edges": """SELECT dashboard_id, widget_id, query_id, pos FROM widgets
  WHERE kind = 'chart'""",
    "counts": """SELECT p_partkey + 1 AS id, p_name AS name, p_size, p_type, p_brand,
  count(DISTINCT dashboard_id) AS dash, count(DISTINCT widget_id) AS chart
  FROM part LEFT JOIN edges ON query_id = p_partkey + 1 GROUP BY ALL""",
    "scored": """SELECT id, name,
  6 * (0.8 * ln(1 + dash) / (SELECT ln(1 + max(dash)) FROM counts)
     + 0.2 * ln(1 + chart) / (SELECT ln(1 + max(chart)) FROM counts)) AS impact,
  3 * exp(-0.02 * p_size) AS recency,
  CASE WHEN p_size % 3 <> 0 THEN 0.5 ELSE 0 END + CASE WHEN p_size % 2 <> 0 THEN 0.5 ELSE 0 END AS curation
  FROM counts""",
    "golden": "SELECT *, impact + recency + curation AS score FROM scored",
    "raw_content": """SELECT o_orderkey + 1 AS id, coalesce(sum(score), 0) AS raw FROM orders
  LEFT JOIN (SELECT DISTINCT dashboard_id, query_id FROM edges) e ON dashboard_id = o_orderkey + 1
  LEFT JOIN golden ON golden.id = query_id GROUP BY 1""",
    "notes": """SELECT dashboard_id AS id, note FROM widgets WHERE kind <> 'chart'
  QUALIFY row_number() OVER (PARTITION BY dashboard_id ORDER BY grid_row, grid_col, pos, note) = 1""",
    "boards": f"""SELECT o_orderkey + 1 AS id, o_custkey, o_orderpriority AS user_name,
  o_orderstatus = 'P' AS is_draft,
  7 * raw / (SELECT max(raw) FROM raw_content) AS content,
  2 * exp(-0.01 * (epoch_us({O_AS_OF}) - epoch_us(o_orderdate)) / 86400e6) AS recency,
  CASE WHEN note IS NULL THEN 0.0 WHEN note = '' THEN 0.5 ELSE 1.0 END AS curation
  FROM orders JOIN raw_content ON raw_content.id = o_orderkey + 1
  LEFT JOIN notes ON notes.id = o_orderkey + 1""",
    "jobs": f"""SELECT event_id, CAST(event_id AS VARCHAR) AS job_id, ts, user_id, event_type, value,
  {USER_EMAIL} AS user_email, {QUERY_TEXT} AS query, 'r' || (user_id % 3) AS region,
  CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'INSERT' WHEN 'purchase' THEN 'MERGE'
    WHEN 'signup' THEN 'CREATE_TABLE_AS_SELECT' END AS statement_type,
  CASE WHEN event_type IN ('view', 'purchase')
    THEN ['p.d.t' || (user_id % 4), 'p.d.dim_' || (user_id % 2)] ELSE ['p.d.t' || (user_id % 4)] END AS refs,
  CASE user_id % 3 WHEN 1 THEN 'p.scratch.t' WHEN 2 THEN 'p.d.t_' || event_type END AS dest,
  {LOW} AS low, {HIGH} AS high, {HIGH_OLD} AS high_old,
  CAST(user_id % 4 AS VARCHAR) AS k, CAST(user_id % 2 AS VARCHAR) AS m FROM events""",
    "shaped": """SELECT *, CASE event_type
    WHEN 'click' THEN 'select user_id,note from `p`.d.t' || k || ' where value>? and note=? limit ?'
    WHEN 'view' THEN 'select a.id,count(distinct b.id)from p.d.t' || k || ' a left join p.d.dim_' || m
      || ' b on a.id=b.id where a.dt>=date ? and(a.dt<=date ?)group by a.id order by ?'
    WHEN 'purchase' THEN replace('with base as(select id,sum(value)as s from p.d.t' || k
      || ' group by id)select base.id,avg(s),max(s)from base join p.d.dim_' || m
      || ' d on base.id=d.id group by base.id', 'base', 'dim_' || m)
    WHEN 'signup' THEN 'select id,row_number()over(partition by kind order by value desc)as rn from p.d.t'
      || k || ' x,p.d.dim_' || m || ' y where value between ? and ? and dt between ? and ?'
    ELSE 'select id from p.d.t' || k || ' where dt>=? and dt<=? and note=? union all select id from p.d.old_t' || k
      || ' where dt>=? and dt<=? and value=?' END AS shape FROM jobs""",
    "shapes": "SELECT *, sha256(shape) AS query_shape_id FROM shaped",
    "gaps": """SELECT query_shape_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY
  query_shape_id ORDER BY ts, job_id)) / 1e6 AS gap FROM shapes""",
    "regular": """SELECT query_shape_id, count(*) = 1 AS is_single_execution,
  CASE WHEN count(*) = 2 THEN 0.0 ELSE stddev_samp(gap) END AS sd FROM gaps GROUP BY 1""",
    "users_of": """SELECT query_shape_id, user_email, count(*) AS runs, min(ts) AS first_run
  FROM shapes GROUP BY 1, 2""",
    "creator": """SELECT query_shape_id, user_email AS creator FROM users_of
  QUALIFY row_number() OVER (PARTITION BY query_shape_id ORDER BY first_run, user_email) = 1""",
    "busiest": """SELECT query_shape_id, user_email AS main_user FROM users_of
  QUALIFY row_number() OVER (PARTITION BY query_shape_id ORDER BY runs DESC, first_run, user_email) = 1""",
    "first_kind": """SELECT query_shape_id, statement_type FROM shapes
  QUALIFY row_number() OVER (PARTITION BY query_shape_id ORDER BY ts, statement_type) = 1""",
    "targets": """SELECT query_shape_id, CASE WHEN count(DISTINCT dest) = 1 THEN min(dest) END AS dest
  FROM shapes GROUP BY 1""",
    "structure": """SELECT DISTINCT query_shape_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN 1 ELSE 0 END AS joins,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ctes,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS windows,
  CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS subqueries,
  event_type IN ('view', 'purchase') AS grouped FROM shapes""",
    "weights": """SELECT *, joins + 2 * ctes + 3 * windows + subqueries + CAST(grouped AS INT) AS raw
  FROM structure""",
    "windows": """SELECT *, CASE event_type WHEN 'view' THEN low || '..' || high
    WHEN 'signup' THEN low || '..' || high
    WHEN 'error' THEN CASE WHEN greatest(low, '2024-01-04') <= least('2024-01-20', high_old)
      THEN greatest(low, '2024-01-04') || '..' || least('2024-01-20', high_old) END END AS date_window
  FROM jobs""",
    "pairs": f"""SELECT *, event_id % 4 AS variant, {OTHER_TEXT} AS other FROM windows""",
    "judged": """SELECT event_id, variant, event_type,
  (variant = 0 AND event_type IN ('click', 'error')) AS other_literal,  -- their notes hold spaces
  (variant = 2 AND event_type <> 'click') AS other_table,
  (variant = 3 AND event_type NOT IN ('click', 'purchase')) AS other_dates,
  (variant = 1 AND event_type NOT IN ('view', 'signup')) AS new_order,
  (variant = 1) AS ordered, date_window, low, high_old FROM pairs""",
    "changed": """SELECT *, concat_ws(',', CASE WHEN other_table THEN 'leaf_tables' END,
    CASE WHEN other_table AND event_type IN ('view', 'signup') THEN 'join_edges' END,
    CASE WHEN new_order THEN 'has_order_by' END,
    CASE WHEN other_dates AND date_window IS NOT NULL THEN 'date_window' END) AS parts,
  concat_ws(',', CASE WHEN other_dates AND date_window IS NOT NULL THEN 'date_window' END,
    CASE WHEN new_order THEN 'has_order_by' END,
    CASE WHEN other_table AND event_type IN ('view', 'signup') THEN 'join_edges' END,
    CASE WHEN other_table THEN 'leaf_tables' END) AS sorted_parts,
  CASE WHEN other_dates THEN CASE event_type WHEN 'error' THEN 3 ELSE 1 END
       WHEN other_table OR other_literal THEN 1 ELSE 0 END AS swapped FROM judged""",
    "physical": """SELECT CASE WHEN o_orderstatus = 'O' THEN 'EU' ELSE 'US' END AS region,
  o_orderpriority AS table_schema, 'orders_' || (o_custkey % 50) AS base,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '_%Y%m%d')
    WHEN 1 THEN strftime(o_orderdate, '_%Y_%m_%d') WHEN 2 THEN strftime(o_orderdate, '_%Y%m')
    ELSE '' END AS suffix FROM orders""",
    "task_counts": """SELECT o_orderkey, count(DISTINCT l_partkey) AS dependent_count,
  count(DISTINCT l_suppkey) AS dependency_count,
  count(*) FILTER (l_quantity > 25) AS subtask_count, count(*) FILTER (l_returnflag = 'A') AS comment_count,
  count(DISTINCT l_linenumber) AS follower_count
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "dated": """SELECT o.*, c.* EXCLUDE (o_orderkey), o_orderstatus = 'F' AS is_completed,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 2 = 0
    THEN date_trunc('day', o_orderdate + INTERVAL 30 DAY) + INTERVAL 1 DAY - INTERVAL 1 SECOND
    ELSE o_orderdate + INTERVAL 30 DAY END AS due
  FROM orders o JOIN task_counts c USING (o_orderkey)""",
    "peak": """SELECT ln(1 + max(dependent_count)) AS a, ln(1 + max(dependency_count)) AS b,
  ln(1 + max(subtask_count)) AS c, ln(1 + max(comment_count)) AS d, ln(1 + max(follower_count)) AS e
  FROM dated""",
    "parts": f"""SELECT dated.*,
  5 * (0.7 * ln(1 + dependent_count) / a + 0.3 * ln(1 + dependency_count) / b) AS impact,
  3 * (0.5 * ln(1 + subtask_count) / c + 0.3 * ln(1 + comment_count) / d
     + 0.2 * ln(1 + follower_count) / e) AS engagement,
  CASE WHEN floor((epoch_us(due) - epoch_us({O_AS_OF})) / 86400e6) < 0 THEN 1.0
       WHEN floor((epoch_us(due) - epoch_us({O_AS_OF})) / 86400e6) <= 7 THEN 0.5 ELSE 0.0 END
  + exp(-0.02 * floor((epoch_us({O_AS_OF}) - epoch_us(o_orderdate)) / 86400e6)) AS timeliness
  FROM dated, peak""",
    "ranked": """SELECT *, (impact + engagement + timeliness) * CASE WHEN is_completed THEN 0.2 ELSE 1 END
  AS score FROM parts""",
    "tree": "SELECT c_custkey // 4 AS parent, c_custkey + 1 AS child FROM customer",
    "repo_of": "SELECT s_nationkey AS org, s_suppkey AS repo FROM supplier",
    "files_of": """SELECT l_suppkey AS repo, count(*) AS files FROM lineitem
  WHERE NOT (l_linestatus = 'F' AND l_linenumber = 2) AND l_linenumber <> 1 GROUP BY 1""",
    "prs_of": """SELECT l_suppkey AS repo, count(*) AS prs FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' GROUP BY 1""",
    "commits_of": """SELECT l_suppkey AS repo, count(DISTINCT (l_orderkey, l_linenumber)) AS commits
  FROM lineitem GROUP BY 1""",
    "repo_record": """SELECT org, repo, coalesce(files, 0) AS files, coalesce(prs, 0) AS prs,
  coalesce(commits, 0) AS commits FROM repo_of LEFT JOIN files_of USING (repo)
  LEFT JOIN prs_of USING (repo) LEFT JOIN commits_of USING (repo)""",
    "card": """SELECT p_partkey AS id, p_name AS name, CASE p_type WHEN 'PROMO' THEN 'models'
  WHEN 'SMALL' THEN 'metrics' ELSE 'cards' END AS artifact FROM part""",
    "logged": f"""SELECT *, 'dag_' || user_id AS dag_id, 't' || (event_id % 3) AS task_id, {LOG_STATE} AS st
  FROM events""",
    "states": """SELECT dag_id, task_id, max_by(upper(st), ts) AS state, bool_or(st = 'FAILED') AS ever_failed
  FROM logged WHERE st IS NOT NULL GROUP BY 1, 2""",
    "run_state": """SELECT dag_id, count(*) AS tasks, CASE WHEN bool_or(ever_failed) THEN 'dag_failed'
    WHEN bool_and(state = 'SUCCESS') THEN 'dag_succeeded' ELSE 'monitoring_timed_out' END AS status
  FROM states GROUP BY 1""",
    "points": f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'gcp_' || event_type
    WHEN event_type = 'click' THEN 'task_requests_total' ELSE event_type || '_seconds' END AS metric,
  'r' || (user_id % 3) AS region, 'i' || (user_id % 5) AS instance_id, ts, value FROM events""",
    "hashes": f"""SELECT user_id AS task_id, ts, {HASH_FIELD} AS field, {HASH_VALUE} AS val FROM events""",
    "snapshot": """SELECT task_id, max_by(val, ts) FILTER (field = 'state') AS state,
  max_by(val, ts) FILTER (field = 'pr_url') AS pr_url, max_by(val, ts) FILTER (field = 'error') AS error,
  max_by(val, ts) FILTER (field = 'task_json') AS task_json,
  max_by(val, ts) FILTER (field = 'started_at') AS started_at FROM hashes GROUP BY 1""",
    "staged": f"""SELECT event_id, user_id AS task_id, {STAGE} AS stage, coalesce(lag({STAGE}) OVER (
  PARTITION BY user_id ORDER BY ts, event_id), 'INIT') AS from_stage FROM events""",
    "progressed": f"""SELECT user_id AS task_id,
  max_by({STAGE}, ts) FILTER (event_type <> 'click') AS stage,
  CASE WHEN count(*) FILTER (event_type <> 'click') > 0 THEN 'RUNNING' END AS status,
  CAST(coalesce(max(event_id % 250) FILTER (event_type = 'click'), 0) AS INT) AS progress,
  count(*) FILTER (event_type = 'click') AS ticks FROM events GROUP BY 1""",
    "activity": """SELECT CAST(user_id AS VARCHAR) AS entity_id, count(DISTINCT event_type) AS types,
  count(*) AS n FROM events GROUP BY 1""",
    "spending": """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, count(*) AS n, sum(o_totalprice) AS total
  FROM orders GROUP BY 1""",
    "viewed": """SELECT entity_id, types AS distinct_event_types, a.n AS event_count, s.n AS order_count,
  round(total, 2) AS total FROM activity a FULL JOIN spending s USING (entity_id)""",
}

EDGES = ("widgets", "edges")
GOLDEN = (*EDGES, "counts", "scored", "golden")
BOARDS = (*GOLDEN, "raw_content", "notes", "boards")
SHAPES = ("jobs", "shaped", "shapes")
TASKS = ("task_counts", "dated", "peak", "parts", "ranked")
REPOS = ("repo_of", "files_of", "prs_of", "commits_of", "repo_record")
PAIRS = ("jobs", "windows", "pairs", "judged", "changed")
HISTORY = f"strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
MOVES = """('INIT', 'PLANNING'), ('PLANNING', 'WAIT_RFC'), ('PLANNING', 'EXECUTING'),
('WAIT_RFC', 'WAIT_RFC'), ('WAIT_RFC', 'EXECUTING'), ('WAIT_RFC', 'STOPPED'),
('EXECUTING', 'EXECUTING'), ('EXECUTING', 'DONE'), ('EXECUTING', 'STOPPED')"""

ORACLE: dict[str, str] = {}


def define(name: str, ctes: tuple[str, ...], body: str, recursive: str = "") -> None:
    parts = [f"{c} AS ({CTES[c]})" for c in ctes]
    if recursive:
        parts.append(recursive)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n" if parts else ""
    ORACLE[name] = head + body


def _stats(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{out}' AS score, round(min({c}), 6) AS lowest, round(max({c}), 6) AS highest, "
        f"round(avg({c}), 6) AS average FROM {table}" for out, c in columns.items())


# ---- BI assets
define("asset_downstream_counts", (*EDGES, "counts"), """SELECT id,
 CASE WHEN p_brand = 'Brand#1' THEN 'maker' ELSE p_brand END AS user_name,
 dash AS downstream_dashboard_count, chart AS downstream_chart_count FROM counts""")
define("golden_query_score", GOLDEN, """SELECT id, name, round(impact, 6) AS impact_score,
 round(recency, 6) AS recency_score, round(curation, 6) AS curation_score,
 round(score, 6) AS golden_query_score FROM golden""")
define("golden_dashboard_score", BOARDS, """SELECT id, user_name, is_draft,
 round(content, 6) AS content_quality_score, round(recency, 6) AS recency_score,
 round(curation, 6) AS curation_score, round(content + recency + curation, 6) AS golden_dashboard_score
 FROM boards""")
define("top_golden_queries", GOLDEN, """SELECT id, name, round(score, 6) AS golden_query_score FROM golden
 ORDER BY score DESC, id LIMIT 5""")
define("top_golden_dashboards", BOARDS, """SELECT id,
 left('Weekly revenue and refunds overview of customer no. ' || o_custkey, 50) || '...' AS name, is_draft,
 (SELECT count(DISTINCT query_id) FROM edges WHERE dashboard_id = boards.id) AS query_count,
 round(content + recency + curation, 6) AS golden_dashboard_score FROM boards
 ORDER BY content + recency + curation DESC, id LIMIT 5""")
define("query_score_stats", GOLDEN, _stats("golden", {
    "impact_score": "impact", "recency_score": "recency", "golden_query_score": "score"}))
define("widget_type_stats", ("widgets",), """SELECT coalesce(kind, 'total') AS widget_type,
 count(*) AS widgets, count(*) FILTER (kind_each = 'chart' AND query_id = 0) AS without_query
 FROM (SELECT kind AS kind_each, kind, query_id FROM widgets) GROUP BY ROLLUP (kind)""")
define("chart_edges_counting_mode", EDGES, "SELECT dashboard_id, count(*) AS edges FROM edges GROUP BY 1")
define("accessible_widgets", EDGES, """SELECT widget_id, query_id FROM (SELECT widget_id, query_id
 FROM edges QUALIFY row_number() OVER (PARTITION BY widget_id ORDER BY pos DESC, query_id DESC) = 1)
 WHERE query_id IN (SELECT p_partkey + 1 FROM part WHERE p_type <> 'LARGE')""")
define("orphan_edges", EDGES, """SELECT DISTINCT query_id FROM edges WHERE query_id NOT IN
 (SELECT p_partkey + 1 FROM part WHERE p_type <> 'LARGE')""")
define("lineage_summary", EDGES, """SELECT count(DISTINCT query_id) AS queries_with_dashboards,
 count(DISTINCT query_id) AS queries_with_charts, count(DISTINCT dashboard_id) AS dashboards_with_queries
 FROM edges""")
define("dashboard_query_counts", EDGES, """SELECT o_orderkey + 1 AS id, o_orderstatus = 'P' AS is_draft,
 count(DISTINCT query_id) AS query_count FROM orders LEFT JOIN edges ON dashboard_id = o_orderkey + 1
 GROUP BY 1, 2""")
define("asset_counts", (), f"""SELECT (SELECT count(*) FROM orders) AS dashboards,
 (SELECT count(*) FROM ({ORACLE['accessible_widgets']})) AS widgets,
 (SELECT count(*) FROM part) AS saved_queries""")
define("phase_summary", (), """SELECT count(*) AS queries_listed,
 count(*) FILTER (p_type <> 'LARGE') AS queries_fetched,
 count(*) FILTER (p_type = 'LARGE') AS queries_failed,
 (SELECT count(*) FROM orders) AS dashboards FROM part""")

# ---- query log
define("query_shapes", SHAPES, f"""SELECT query_shape_id, shape AS normalized_sql,
 count(*) AS total_execution_count, count(DISTINCT user_email) AS distinct_user_count,
 strftime(max(ts), {TS}) AS last_execution_timestamp FROM shapes GROUP BY 1, 2""")
define("query_shapes_masked_once", SHAPES,
       "SELECT query_shape_id, count(*) AS executions FROM shapes GROUP BY 1")
define("query_structure", (*SHAPES, "structure", "weights"), """SELECT query_shape_id,
 joins AS join_count, ctes AS cte_count, windows AS window_function_count,
 subqueries AS subquery_count, grouped AS aggregation_presence, raw AS raw_complexity_score,
 round(raw / (SELECT max(raw) FROM weights), 6) AS complexity_score FROM weights""")
define("query_regularity", (*SHAPES, "gaps", "regular"), """SELECT query_shape_id, is_single_execution,
 round(sd, 4) AS execution_regularity_stdev FROM regular""")
define("query_ownership", (*SHAPES, "users_of", "creator", "busiest", "first_kind"), """SELECT
 query_shape_id, creator AS creator_first_seen_user, main_user AS primary_user_most_frequent_executor,
 statement_type, main_user LIKE '%.iam.gserviceaccount.com' AS is_service_account,
 coalesce(statement_type IN ('INSERT', 'MERGE', 'CREATE_TABLE_AS_SELECT'), false) AS is_dml
 FROM creator JOIN busiest USING (query_shape_id) JOIN first_kind USING (query_shape_id)""")
define("query_lineage", (*SHAPES, "targets"), """SELECT DISTINCT query_shape_id, source_table,
 t.dest AS destination_table, coalesce(contains(t.dest, 'scratch'), false) AS is_temporary_write,
 t.dest IS NOT NULL AND NOT contains(t.dest, 'scratch') AS has_persistent_destination
 FROM (SELECT query_shape_id, unnest(refs) AS source_table FROM shapes)
 JOIN targets t USING (query_shape_id)""")
define("golden_query_features",
       (*SHAPES, "gaps", "regular", "users_of", "creator", "busiest", "first_kind", "targets",
        "structure", "weights"),
       f"""SELECT s.query_shape_id, statement_type, total_execution_count, distinct_user_count,
 strftime(last_run, {TS}) AS last_execution_timestamp, creator AS creator_first_seen_user,
 main_user AS primary_user_most_frequent_executor, joins AS join_count, ctes AS cte_count,
 windows AS window_function_count, grouped AS aggregation_presence, subqueries AS subquery_count,
 dest AS destination_table, coalesce(contains(dest, 'scratch'), false) AS is_temporary_write,
 round(sd, 4) AS execution_regularity_stdev, is_single_execution, shape AS normalized_sql,
 round((epoch_us({E_AS_OF}) - epoch_us(last_run)) / 3.6e9, 6) AS hours_since_last_run,
 CASE WHEN is_single_execution THEN 'SINGLE_EXECUTION'
   ELSE CAST(CAST(floor(round(sd / 3600, 2) * 10 + 0.01) AS BIGINT) AS VARCHAR) END AS regularity_tenths,
 round(raw / (SELECT max(raw) FROM weights), 6) AS complexity_score, source_table_count,
 main_user LIKE '%.iam.gserviceaccount.com' AS is_service_account,
 dest IS NOT NULL AND NOT contains(dest, 'scratch') AS has_persistent_destination,
 coalesce(statement_type IN ('INSERT', 'MERGE', 'CREATE_TABLE_AS_SELECT'), false) AS is_dml
 FROM (SELECT query_shape_id, shape, count(*) AS total_execution_count,
   count(DISTINCT user_email) AS distinct_user_count, max(ts) AS last_run,
   max(len(refs)) AS source_table_count FROM shapes GROUP BY 1, 2) s
 JOIN regular USING (query_shape_id) JOIN creator USING (query_shape_id)
 JOIN busiest USING (query_shape_id) JOIN first_kind USING (query_shape_id)
 JOIN targets USING (query_shape_id) JOIN weights USING (query_shape_id)""")
define("query_history", SHAPES, f"""SELECT query_shape_id, (n - 1) // 100 AS segment,
 string_agg({HISTORY}, ',' ORDER BY n) AS full_execution_history FROM (SELECT *, row_number() OVER (
   PARTITION BY query_shape_id ORDER BY ts, job_id) AS n FROM shapes) GROUP BY 1, 2""")
define("query_shape_users", (*SHAPES, "users_of"), f"""SELECT query_shape_id, user_email, runs,
 strftime(first_run, {TS}) AS first_run FROM users_of""")
define("query_export", SHAPES, f"""SELECT query_shape_id, users, history, total_execution_count,
 (SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT unnest(refs) AS r FROM shapes x
   WHERE x.query_shape_id = s.query_shape_id)) AS sources
 FROM (SELECT query_shape_id, string_agg(DISTINCT user_email, ',' ORDER BY user_email) AS users,
   string_agg({HISTORY}, ',' ORDER BY ts, job_id) AS history, count(*) AS total_execution_count
   FROM shapes GROUP BY 1) s""")
define("finished_jobs", ("jobs",), f"""SELECT job_id, region, user_email, strftime(ts, {TS}) AS start_time
 FROM jobs WHERE value <= 100 AND ts >= {E_AS_OF} - INTERVAL 20 DAY""")
define("top_raw_queries", ("jobs",), """SELECT query, count(*) AS executions FROM jobs GROUP BY 1
 ORDER BY executions DESC, sha256(query) LIMIT 50000""")
define("query_previews", ("jobs",), """SELECT left(query, 100) AS preview, count(*) AS executions
 FROM jobs GROUP BY query ORDER BY executions DESC, sha256(query) LIMIT 5""")
define("candidate_jobs", ("jobs",), """SELECT job_id, user_email, query FROM jobs WHERE query IN (
 SELECT query FROM jobs GROUP BY query ORDER BY count(*) DESC, sha256(query) LIMIT 50000)""")
define("coverage_reduction", SHAPES, """SELECT count(*) AS jobs, count(DISTINCT shape) AS shapes,
 round((1 - count(DISTINCT shape) / count(*)) * 100, 6) AS reduction_pct FROM shapes""")
define("query_signatures", ("jobs", "windows"), """SELECT job_id, CASE event_type
   WHEN 'click' THEN 'd.t' || k
   WHEN 'error' THEN 'd.old_t' || k || ',d.t' || k ELSE 'd.dim_' || m || ',d.t' || k END AS leaf_tables,
 CASE event_type WHEN 'view' THEN 'd.dim_' || m || '|d.t' || k || '|left'
   WHEN 'signup' THEN 'd.dim_' || m || '|d.t' || k || '|inner' ELSE '' END AS join_edges,
 CASE event_type WHEN 'view' THEN 'count distinct' WHEN 'purchase' THEN 'avg,max,sum' ELSE '' END AS agg_funcs,
 CASE event_type WHEN 'error' THEN 'UNION ALL' ELSE '' END AS set_ops,
 event_type = 'click' AS has_limit, event_type IN ('view', 'signup') AS has_order_by, date_window
 FROM windows""")
define("signature_diff", PAIRS, """SELECT event_id, NOT (ordered OR other_table OR other_dates OR other_literal) AS text_equal,
 NOT (ordered OR other_table) AS shape_equal, parts = '' AS signature_equal, parts AS changed_parts,
 swapped AS tokens_removed, CASE WHEN ordered THEN 3 ELSE swapped END AS tokens_added FROM changed""")
define("signature_comparison", PAIRS, """SELECT event_id, parts = '' AS signature_equal,
 sorted_parts AS changed_parts FROM changed""")
define("date_window_intersection", ("jobs", "windows"), "SELECT job_id, date_window FROM windows")

# ---- warehouse inventory
define("logical_tables", ("physical",), "SELECT DISTINCT table_schema, base AS logical_name FROM physical")
define("unique_queries_by_region", ("jobs",),
       "SELECT region, count(DISTINCT query) AS unique_queries FROM jobs GROUP BY 1")
define("sketched_unique_queries", ("jobs",),
       "SELECT region, count(DISTINCT query) AS unique_queries, true AS near FROM jobs GROUP BY 1")
define("inventory_counts", ("physical", "jobs"), """SELECT
 (SELECT count(DISTINCT o_orderpriority) FROM orders) AS datasets,
 (SELECT count(DISTINCT base) FROM physical) AS logical_tables,
 (SELECT sum(n) FROM (SELECT count(DISTINCT query) AS n FROM jobs GROUP BY region)) AS unique_queries""")
define("unique_queries_overall", ("jobs",), "SELECT count(DISTINCT query) AS unique_queries FROM jobs")
define("region_datasets", (), """SELECT CASE WHEN o_orderstatus = 'O' THEN 'EU' ELSE 'US' END AS region,
 string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS datasets FROM orders GROUP BY 1""")
define("tables_in_datasets", ("physical",), """SELECT region, table_schema, base || suffix AS table_name
 FROM physical WHERE region = 'EU'""")

# ---- tasks
define("task_features", ("task_counts", "dated"), """SELECT CAST(o_orderkey AS VARCHAR) AS id,
 'https://tasks.example/' || o_orderkey AS url, is_completed,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN strftime(due, '%Y-%m-%d')
   ELSE strftime(due, '%Y-%m-%dT%H:%M:%SZ') END AS due_date,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS last_modified_at, dependent_count, dependency_count,
 subtask_count, comment_count, follower_count FROM dated""")
define("golden_task_score", TASKS, """SELECT CAST(o_orderkey AS VARCHAR) AS id,
 round(impact, 6) AS impact_score, round(engagement, 6) AS engagement_score,
 round(timeliness, 6) AS timeliness_recency_score, round(score, 6) AS golden_task_score FROM ranked""")
define("top_golden_tasks", TASKS, """SELECT row_number() OVER (ORDER BY score DESC, impact DESC,
   CAST(o_orderkey AS VARCHAR)) AS rank, CAST(o_orderkey AS VARCHAR) AS id, 'Task ' || o_orderkey AS name,
 round(score, 6) AS golden_task_score FROM ranked QUALIFY rank <= 5""")
define("task_score_stats", TASKS, _stats("ranked", {
    "golden_task_score": "score", "impact_score": "impact", "engagement_score": "engagement",
    "timeliness_recency_score": "timeliness"}))
define("task_completion", (), """SELECT count(*) FILTER (o_orderstatus = 'F') AS completed,
 count(*) FILTER (o_orderstatus <> 'F') AS incomplete,
 round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 1) AS completed_pct,
 round(count(*) FILTER (o_orderstatus <> 'F') / count(*) * 100, 1) AS incomplete_pct FROM orders""")
define("task_quality", ("task_counts",), """SELECT count(*) AS tasks,
 round(count(*) FILTER (dependency_count > 0) / count(*) * 100, 1) AS with_dependencies_pct,
 round(count(*) FILTER (dependent_count > 0) / count(*) * 100, 1) AS with_dependents_pct,
 round(count(*) FILTER (comment_count > 0) / count(*) * 100, 1) AS with_comments_pct,
 round(count(*) FILTER (subtask_count > 0) / count(*) * 100, 1) AS with_subtasks_pct FROM task_counts""")
define("task_output", (), """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Project ' || o_custkey AS project_name,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE '' END AS assignee,
 CASE WHEN o_orderstatus = 'O' THEN 'inbox' ELSE '' END AS assignee_status,
 'Priority: ' || o_orderpriority || '; Status: ' || CASE WHEN o_orderstatus = 'F' THEN '(empty)'
   ELSE o_orderstatus END || '; Size: ' || (o_custkey % 5) || '.0' AS custom_fields FROM orders""")
define("task_details_merged", (), """SELECT o_orderkey AS gid, o_orderpriority AS assignee,
 CASE WHEN o_totalprice > 250000 THEN 'D-' || o_orderstatus ELSE o_orderstatus END AS name,
 CASE WHEN o_totalprice > 250000 THEN o_custkey END AS project_gid FROM orders""")
define("task_projects", (), """SELECT CAST(o_orderkey AS VARCHAR) AS gid, c_nationkey AS workspace_id,
 c_name AS project_name FROM orders JOIN customer ON c_custkey = o_custkey""")
_CLOSURE = """walk AS (SELECT DISTINCT parent AS root, parent AS node, 0 AS depth FROM tree
 UNION ALL SELECT w.root, t.child, w.depth + 1 FROM walk w JOIN tree t ON t.parent = w.node)"""
define("subtask_closure", ("tree",), """SELECT root AS root_gid, parent AS parent_gid, child AS task_gid,
 depth + 1 AS depth FROM walk JOIN tree ON parent = node""", _CLOSURE)
define("subtask_counts", ("tree",), """SELECT root AS gid, count(*) AS subtask_count
 FROM walk JOIN tree ON parent = node GROUP BY 1""", _CLOSURE)

# ---- repositories
define("repo_metrics", REPOS, "SELECT * FROM repo_record")
define("repo_totals", REPOS, """SELECT count(*) AS repos, sum(files) AS files, sum(prs) AS prs,
 sum(commits) AS commits FROM repo_record""")
define("repo_summary", REPOS, """SELECT count(*) AS repos, sum(files) AS files, sum(prs) AS prs,
 sum(commits) AS commits, count(*) FILTER (files > 0) AS repos_with_files,
 count(*) FILTER (prs > 0) AS repos_with_prs, count(*) FILTER (commits > 0) AS repos_with_commits,
 round(sum(files) / count(*), 2) AS avg_files_per_repo, round(sum(prs) / count(*), 2) AS avg_prs_per_repo,
 round(sum(commits) / count(*), 2) AS avg_commits_per_repo FROM repo_record""")
define("repo_active_share", REPOS, """SELECT count(*) FILTER (files + prs + commits > 0) AS active_repos,
 count(*) AS repos, round(count(*) FILTER (files + prs + commits > 0) / count(*) * 100, 1) AS active_pct,
 round(sum(files) / count(*), 1) AS avg_files, round(sum(prs) / count(*), 1) AS avg_prs,
 round(sum(commits) / count(*), 1) AS avg_commits FROM repo_record""")
define("repo_activity_rank", REPOS, """SELECT org, repo, files + prs + commits AS activity FROM repo_record""")
_TEXT = """SELECT '{kind}' AS kind, count(*) AS files, count(*) FILTER (
 len(list_filter(bytes, lambda b: b BETWEEN '20' AND '7E' OR b IN ('09', '0A', '0D')))
   / greatest(len(bytes), 1) > 0.9 AND NOT list_contains(bytes, '00')) AS text_files
 FROM (SELECT regexp_extract_all(hex(encode({col})), '..') AS bytes FROM {table})"""
define("text_file_ratio", (), _TEXT.format(kind="documents", col="text", table="documents") + " UNION ALL "
       + _TEXT.format(kind="pages", col="html", table="pages"))

# ---- BI catalog
define("card_type_counts", ("card",), """SELECT count(*) AS total_cards,
 count(*) FILTER (artifact = 'cards') AS questions, count(*) FILTER (artifact = 'models') AS models,
 count(*) FILTER (artifact = 'metrics') AS metrics FROM card""")
define("card_samples", ("card",), """SELECT artifact, 'list' AS kind, id, name FROM card
 QUALIFY row_number() OVER (PARTITION BY artifact ORDER BY id) <= 5""")
define("card_result_samples", (), """SELECT card_id, row_number, count(*) OVER (PARTITION BY card_id)
 AS row_count_sampled, order_text, line_text, CAST(NULL AS VARCHAR) AS missing FROM (
 SELECT l_partkey AS card_id, CAST(l_orderkey AS VARCHAR) AS order_text,
 CAST(l_linenumber AS VARCHAR) AS line_text, row_number() OVER (PARTITION BY l_partkey
   ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS row_number
 FROM lineitem QUALIFY row_number <= 10)""")
define("artifact_counts", (), """SELECT 'collections' AS artifact, count(*) AS items FROM nation
 UNION ALL SELECT 'dashboards', count(*) FROM orders UNION ALL SELECT 'segments', count(*) FROM supplier
 UNION ALL SELECT 'snippets', count(*) FROM benchmark""")

# ---- workflow logs
define("dag_task_states", ("logged", "states"), "SELECT * FROM states")
for _name in ("dag_status", "monitor_summary_stream"):
    define(_name, ("logged", "states", "run_state"), "SELECT * FROM run_state")
define("dag_status_stream", ("logged", "states", "run_state"), """SELECT dag_id, status
 FROM run_state""")
define("dag_task_states_stream", ("logged", "states"), "SELECT * FROM states")
define("dag_log_scan", ("logged",), f"""SELECT strftime(ts, {TS}) AS timestamp, dag_id,
 'Marking task as ' || st || '. dag_id=' || dag_id || ', task_id=' || task_id || ', run_id=r1' AS payload
 FROM logged WHERE st IS NOT NULL AND ts > TIMESTAMP '2024-01-15 12:00:00' AND user_id % 2 = 1
 AND dag_id LIKE 'dag_1%'""")

# ---- metrics
define("latest_metric_5m", ("points",), """SELECT metric, region, coalesce(max_by(value, ts) FILTER (
 ts BETWEEN TIMESTAMP '2024-01-20 11:55:00' AND TIMESTAMP '2024-01-20 12:00:00'), 0.0) AS value
 FROM points GROUP BY 1, 2""")
for _name in ("latest_metric_windows", "latest_metric_stream"):
    define(_name, ("points",), f"""SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), {TS})
 AS window_start, metric, region, max_by(value, ts) AS value FROM points
 GROUP BY time_bucket(INTERVAL 5 MINUTE, ts), metric, region""")
define("metric_sanitise", ("points",), f"""SELECT metric, 'instance_id=' || instance_id || ',region=' || region
 AS labels, strftime(ts, {TS}) AS ts, value FROM points
 WHERE metric LIKE 'gcp\\_%' ESCAPE '\\' OR metric = 'task_requests_total'""")
for _name in ("counter_totals", "counter_totals_stream"):
    define(_name, (), "SELECT event_type AS counter, count(*) AS total FROM events GROUP BY 1")

# ---- task, document and feedback state
for _name in ("task_state_snapshot", "task_snapshot_stream"):
    define(_name, ("hashes", "snapshot"), "SELECT * FROM snapshot")
define("task_status_labels", ("hashes", "snapshot"), """SELECT task_id, coalesce(state, 'unknown') AS state,
 status, CASE WHEN status = 'COMPLETED' THEN pr_url END AS pr_url,
 CASE WHEN status = 'FAILED' THEN coalesce(error, 'Unknown error') END AS error,
 task_json ->> '$.engine' AS engine, started_at FROM (SELECT *, CASE WHEN state = 'done' AND pr_url IS NOT NULL
   THEN 'COMPLETED' WHEN state = 'running' THEN 'PROCESSING' WHEN state = 'failed' THEN 'FAILED'
   ELSE 'QUEUED' END AS status FROM snapshot)""")
define("task_stage_checks", ("staged",), f"""SELECT event_id, task_id, from_stage, stage,
 (from_stage, stage) IN ({MOVES}) AS valid FROM staged""")
for _name in ("task_progress", "task_progress_stream"):
    define(_name, ("progressed",), "SELECT *, progress >= 200 AS done FROM progressed")
define("user_recent_tasks", (), """SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id) AS position FROM events QUALIFY position <= 50""")
define("tasks_of_users", (), """SELECT o_custkey AS user_id, o_orderkey AS task_id, lower(c_name) AS email
 FROM orders JOIN customer ON c_custkey = o_custkey""")
define("users_ensured", (), """SELECT lower(c_name) AS email, true AS was_known FROM customer
 WHERE c_acctbal > 0 UNION ALL
 SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'anonymous-' || d[1:8] || '-' || d[9:12] || '-' || d[13:16]
   || '-' || d[17:20] || '-' || d[21:32] || '@example.com' ELSE lower(c_name) END, false
 FROM (SELECT *, md5(CAST(c_custkey AS VARCHAR)) AS d FROM customer)
 WHERE c_acctbal <= 0 OR (c_mktsegment = 'MACHINERY' AND c_nationkey % 2 <> 0)""")
define("feedback_concat", (), """SELECT conv_id AS document_id, coalesce((n - 1) // 1000, 0) AS segment,
 string_agg(text, ' | ' ORDER BY turn) AS feedback,
 count(n) AS feedback_count FROM (SELECT d.conv_id, c.turn, c.text, CASE WHEN c.turn IS NOT NULL THEN
   row_number() OVER (PARTITION BY d.conv_id ORDER BY c.turn) END AS n
   FROM (SELECT conv_id FROM conversations UNION SELECT doc_id FROM documents) d
   LEFT JOIN conversations c ON c.conv_id = d.conv_id) GROUP BY 1, 2""")
define("latest_document", (), """SELECT conv_id AS task_id, turn AS version, role AS kind, text AS body
 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
define("document_locks", (), """SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels
 WHERE toxic = 1) THEN NULL WHEN doc_id IN (SELECT doc_id FROM labels
 WHERE quality = 1) THEN 'LOCKED' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'REVIEW'
 ELSE 'DRAFT' END AS status FROM documents""")
define("unmatched_updates", (), """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (
 SELECT doc_id FROM labels)""")
define("folded_updates", (), """SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role,
 max_by(text, turn) AS text FROM conversations GROUP BY 1""")

# ---- feature tables
define("feature_view", ("activity", "spending", "viewed"), "SELECT * FROM viewed")
define("feature_view_of_pairs", (), r"""SELECT l_returnflag || '\||' || l_linestatus AS entity_id,
 count(*) AS lines, NULL::BIGINT AS suppliers FROM lineitem GROUP BY 1
 UNION ALL SELECT l_returnflag || '|\|' || l_linestatus, NULL, count(DISTINCT l_suppkey) FROM lineitem GROUP BY 1""")
define("feature_lookup", ("activity", "spending", "viewed"), """SELECT w.entity_id,
 v.entity_id IS NOT NULL AS found, event_count, order_count FROM (
 SELECT CAST(s_suppkey AS VARCHAR) AS entity_id FROM supplier UNION
 SELECT CAST(p_partkey AS VARCHAR) FROM part) w LEFT JOIN viewed v ON v.entity_id = w.entity_id""")
define("feature_key_check", (), """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
 GROUP BY 1, 2 HAVING count(*) > 1""")
define("distinct_event_types", (), """SELECT user_id, count(DISTINCT event_type) AS distinct_event_types
 FROM events GROUP BY 1""")

# ---- landed files
define("landed_jobs", ("jobs",), f"""SELECT job_id, region, strftime(ts, {TS}) AS creation_time,
 CASE WHEN value > 100 THEN 'RUNNING' ELSE 'DONE' END AS state FROM jobs""")
define("landed_documents", (), """SELECT o_orderkey + 1 AS id, 'd-' || o_orderkey AS slug,
 o_orderpriority AS author, CASE WHEN o_orderstatus = 'P' THEN true END AS is_draft FROM orders""")
define("exported_records", (), "SELECT event_id, event_type, value FROM events")
define("exported_csv", (), """SELECT CAST(p_partkey + 1 AS VARCHAR) AS id, p_name AS name,
 CASE WHEN p_size % 2 <> 0 THEN '{"interval": 60}' END AS schedule,
 CASE WHEN p_size % 3 <> 0 THEN p_type END AS description FROM part""")
define("dumped_cards", ("card",), "SELECT artifact, 'list' AS kind, id, name FROM card")
define("served_features", ("activity", "spending", "viewed"),
       "SELECT entity_id, event_count, order_count FROM viewed")
define("landed_log", (), """SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
 CASE WHEN ts < TIMESTAMP '2024-01-16 12:00:00' THEN 1 ELSE 2 END AS half FROM events WHERE ts IS NOT NULL""")
define("refreshed_features", ("activity", "spending", "viewed"),
       "SELECT entity_id, event_count, order_count FROM viewed")
define("log_lines_in_order", ("logged",), f"""SELECT strftime(ts, {TS}) AS timestamp, dag_id,
 CASE WHEN st IS NULL THEN 'Heartbeat of task_id=' || task_id ELSE 'Marking task as ' || st || '. dag_id='
   || dag_id || ', task_id=' || task_id || ', run_id=r1' END AS payload FROM logged""")
define("regions_together", ("jobs",), "SELECT region, count(*) AS jobs FROM jobs GROUP BY 1")
define("named_repositories", (), """SELECT * FROM (SELECT CAST(s_nationkey AS VARCHAR) AS org,
 CASE WHEN s_suppkey % 3 = 0 THEN 'slug-' || s_suppkey WHEN s_suppkey % 2 = 0 THEN s_name
   WHEN s_suppkey % 5 <> 0 THEN 'repo-' || s_suppkey END AS repo,
 CASE WHEN s_suppkey % 5 <> 0 THEN 'org/repo-' || s_suppkey END AS full_name,
 CAST(0 AS BIGINT) AS size, 'main' AS default_branch, s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0 AS valid
 FROM supplier) WHERE repo IS NOT NULL""")
define("page_extensions", (), """SELECT CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'json' END AS extension,
 count(*) AS pages FROM pages GROUP BY 1""")
define("date_texts", (), "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_date FROM orders")
define("running_progress", (), """SELECT event_id, CAST(CASE WHEN event_type IN ('view', 'error') THEN 0
 ELSE event_id % 100 END AS INT) AS progress FROM events""")
define("events_of_a_task", (), f"""SELECT strftime(ts, {TS}) AS ts,
 CASE WHEN event_type = 'click' THEN 'tick' ELSE 'stage' END AS type,
 CASE WHEN event_type <> 'click' THEN {STAGE} END AS stage,
 CAST(CASE WHEN event_type = 'click' THEN event_id % 250 END AS INT) AS progress
 FROM events WHERE user_id = 7""")

# ---- SQL surface
_PLACED = """(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
 l_returnflag) AS n FROM lineitem)"""
define("widgets_in_sql", (), f"""SELECT l_orderkey - 1 AS dashboard_id, n - 1 AS pos, l_partkey AS widget_id,
 CASE WHEN l_returnflag <> 'R' THEN l_partkey + 1 END AS query_id, l_returnflag AS text,
 CAST(CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber ELSE 0 END AS INT) AS row, CAST(0 AS INT) AS col,
 CASE l_returnflag WHEN 'R' THEN 'no_visualization' WHEN 'N' THEN 'chart' ELSE 'unknown_type' END AS kind
 FROM {_PLACED} WHERE l_orderkey <> 1""")
define("result_rows_in_sql", (), f"""SELECT l_orderkey AS card_id, CAST(n AS INT) AS row_number,
 CASE WHEN l_returnflag IN ('N', 'R') THEN CAST(l_partkey AS VARCHAR) END AS part_text,
 CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR) END AS line_text,
 CAST(NULL AS VARCHAR) AS missing, CAST(CASE l_returnflag WHEN 'N' THEN 3 ELSE 1 END AS INT) AS n_fields
 FROM {_PLACED} WHERE n <= 3""")
define("signature_parts_in_sql", ("jobs",), """SELECT job_id, unnest(['agg_funcs', 'set_ops', 'has_limit', 'has_order_by'])
 AS part, unnest([CASE event_type WHEN 'view' THEN 'count distinct' WHEN 'purchase' THEN 'avg,max,sum' ELSE '' END,
 CASE event_type WHEN 'error' THEN 'UNION ALL' ELSE '' END,
 CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END,
 CASE WHEN event_type IN ('view', 'signup') THEN 'true' ELSE 'false' END]) AS value FROM jobs""")
define("query_scores_in_sql", GOLDEN, """SELECT id, round(impact, 6) AS impact_score,
 round(recency, 6) AS recency_score, round(curation, 6) AS curation_score FROM golden""")
