"""Driver tables seen as the domain tables of the operators.

Each adapter is a plain projection.  An id of 0 counts as missing in asset records, so keys that
start at 0 are shifted by one there.  Texts that both engines must build alike are SQL
expressions valid in Spark and in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.staging import spread

EVENTS_AS_OF = "2024-02-01 00:00:00"
ORDERS_AS_OF = "2001-07-01 00:00:00"

# Parameters of the logged query texts, by event.
CENTS = "CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING)"
CENTS_UP = "CAST(CAST(FLOOR(value * 100) AS BIGINT) + 10 AS STRING)"
SHARD = "CAST(user_id % 4 AS STRING)"
DIM = "CAST(user_id % 2 AS STRING)"
# A CTE with the name of a table.
CTE = f"'dim_' || {DIM}"
LOW = "'2024-01-0' || CAST(1 + user_id % 5 AS STRING)"
HIGH = "'2024-01-1' || CAST(user_id % 9 AS STRING)"
HIGH_OLD = "'2024-01-0' || CAST(3 + user_id % 4 AS STRING)"
QUOTE = "chr(39)"
LINE = "chr(10)"

QUERY_TEXT = f"""CASE event_type
WHEN 'click' THEN 'SELECT user_id, note -- pick ' || {CENTS} || {LINE} || 'FROM `p`.d.t' || {SHARD}
  || ' WHERE value > ' || {CENTS} || ' AND note = ' || {QUOTE} || 'it' || {QUOTE} || {QUOTE} || 's -- ('
  || {CENTS} || ' union select' || {QUOTE} || ' LIMIT 10;'
WHEN 'view' THEN 'select a.id,  COUNT(DISTINCT b.id)' || {LINE} || ' from p.d.t' || {SHARD}
  || ' a LEFT JOIN p.d.dim_' || {DIM} || ' b ON a.id = b.id WHERE a.dt >= DATE ' || {QUOTE} || {LOW}
  || {QUOTE} || ' AND (a.dt <= DATE ' || {QUOTE} || {HIGH} || {QUOTE} || ') GROUP BY a.id ORDER BY 2'
WHEN 'purchase' THEN 'WITH ' || {CTE} || ' AS (SELECT id, SUM(value) AS s FROM p.d.t' || {SHARD}
  || ' GROUP BY id) SELECT ' || {CTE} || '.id, AVG(s), max(s) FROM ' || {CTE} || ' JOIN p.d.dim_' || {DIM}
  || ' d ON ' || {CTE} || '.id = d.id /* run ' || {CENTS} || ' */ GROUP BY ' || {CTE} || '.id'
WHEN 'signup' THEN 'SELECT id, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY value DESC) AS rn FROM p.d.t'
  || {SHARD} || ' x, p.d.dim_' || {DIM} || ' y WHERE value BETWEEN ' || {CENTS} || ' AND ' || {CENTS_UP} || ' AND dt BETWEEN '
  || {QUOTE} || {LOW} || {QUOTE} || ' AND ' || {QUOTE} || {HIGH} || {QUOTE}
ELSE 'SELECT id FROM p.d.t' || {SHARD} || ' WHERE dt >= ' || {QUOTE} || {LOW} || {QUOTE}
  || ' AND dt <= ' || {QUOTE} || '2024-01-20' || {QUOTE} || ' AND note = ' || {QUOTE} || 'x union y limit ('
  || {QUOTE} || {LINE} || 'UNION ALL' || {LINE}
  || 'SELECT id FROM p.d.old_t' || {SHARD} || ' WHERE dt >= ' || {QUOTE} || '2024-01-04' || {QUOTE}
  || ' AND dt <= ' || {QUOTE} || {HIGH_OLD} || {QUOTE} || ' AND value = ' || {CENTS}
END"""

# A second spelling of each text: reformatted, ordered, on another table, on other dates.
OTHER_TEXT = f"""CASE event_id % 4
WHEN 0 THEN '/* again */ ' || replace(query, ' ', '  ') || ' -- end'
WHEN 1 THEN query || ' ORDER BY id'
WHEN 2 THEN replace(query, 'p.d.t', 'p.d.u')
ELSE replace(query, {QUOTE} || '2024-01-0', {QUOTE} || '2023-12-0') END"""

USER_EMAIL = """CASE WHEN user_id % 10 = 0
THEN 'svc' || CAST(user_id AS STRING) || '@x.iam.gserviceaccount.com'
ELSE 'u' || CAST(user_id AS STRING) || '@corp.example' END"""

LOG_STATE = """CASE WHEN event_type IN ('purchase', 'click') THEN 'success'
WHEN event_type = 'signup' AND value > 30 THEN 'UP_FOR_RETRY'
WHEN event_type = 'error' AND value > 100 THEN 'FAILED' END"""


class Tables:
    """Access to the driver tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        # Stored timestamps carry no zone; read them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    @property
    def query_log(self) -> DataFrame:
        """Events for text work, which takes far longer per row than the scan."""
        return spread(self.events)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _time(column: str):
    return F.col(column).cast("timestamp")


def _iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _ref(dataset, table):
    return F.struct(F.lit("p").alias("project_id"), dataset.alias("dataset_id"),
                    table.alias("table_id"))


def jobs(t: Tables) -> DataFrame:
    table = F.concat(F.lit("t"), F.expr(SHARD))
    dim = F.concat(F.lit("dim_"), F.expr(DIM))
    first = _ref(F.lit("d"), table)
    refs = F.when(F.col("event_type").isin("view", "purchase"),
                  F.array(first, _ref(F.lit("d"), dim))).otherwise(F.array(first))
    lane = F.col("user_id") % 3
    target = (F.when(lane == 1, _ref(F.lit("scratch"), F.lit("t")))
               .when(lane == 2, _ref(F.lit("d"), F.concat(F.lit("t_"), F.col("event_type")))))
    kind = (F.when(F.col("event_type") == "click", "SELECT")
             .when(F.col("event_type") == "view", "INSERT")
             .when(F.col("event_type") == "purchase", "MERGE")
             .when(F.col("event_type") == "signup", "CREATE_TABLE_AS_SELECT"))
    return t.query_log.select(
        F.expr(USER_EMAIL).alias("user_email"), F.expr(QUERY_TEXT).alias("query"),
        _time("ts").alias("creation_time"), _time("ts").alias("start_time"),
        _time("ts").alias("end_time"), kind.alias("statement_type"),
        refs.alias("referenced_tables"), target.alias("destination_table"),
        F.col("event_id").cast("string").alias("job_id"),
        F.concat(F.lit("r"), lane.cast("string")).alias("region"), F.lit("p").alias("project_id"),
        F.lit("QUERY").alias("job_type"),
        F.when(F.col("value") > 100, "RUNNING").otherwise("DONE").alias("state"))


def query_pairs(t: Tables) -> DataFrame:
    texts = t.query_log.select("event_id", F.expr(QUERY_TEXT).alias("query"))
    return texts.select("event_id", F.col("query").alias("left_query"),
                        F.expr(OTHER_TEXT).alias("right_query"))


def widgets(t: Tables) -> DataFrame:
    plain = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    return t.lineitem.select(
        (F.col("l_orderkey") + 1).alias("dashboard_id"),
        F.expr("l_partkey * 1000 + CAST(l_quantity AS BIGINT)").alias("pos"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("widget_id"),
        (~plain).alias("has_visualization"),
        F.when(F.col("l_returnflag") == "N", "text").when(~plain, "chart").alias("viz_type"),
        (F.col("l_partkey") + 1).alias("query_id"),
        F.when(F.col("l_linestatus") == "F", "").otherwise("note").alias("text"),
        F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 3).alias("col"))


def _lines_of_orders(t: Tables, line: Callable[[Column], Column]) -> DataFrame:
    """One array per order, a ``line`` for each of its rows by number and part; it is made of them after
    they have been brought together."""
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    return t.lineitem.groupBy("l_orderkey").agg(rows.alias("rows")).select(
        "l_orderkey", F.transform("rows", line).alias("lines"))


def nested_dashboards(t: Tables) -> DataFrame:
    """Dashboard documents with their widgets inside; that of order 1 has no id."""
    def widget(row: Column) -> Column:
        place = F.when(row["l_suppkey"] % 3 > 0, F.struct(F.struct(
            row["l_linenumber"].cast("int").alias("row"), F.lit(None).cast("int").alias("col"),
            F.lit(1).alias("sizeX"), F.lit(1).alias("sizeY")).alias("position")))
        shown = F.when(row["l_returnflag"] != "R", F.struct(
            F.when(row["l_returnflag"] == "N", "chart").alias("type"),
            F.struct((row["l_partkey"] + 1).alias("id")).alias("query")))
        return F.struct(row["l_partkey"].alias("id"), row["l_returnflag"].alias("text"),
                        place.alias("options"), shown.alias("visualization"))
    return _lines_of_orders(t, widget).select(
        (F.col("l_orderkey") - 1).alias("id"), F.col("lines").alias("widgets"))


def nested_results(t: Tables) -> DataFrame:
    """Card results with their rows inside: lists, objects or bare values; one name stands twice."""
    def text(row: Column) -> Column:
        part, flag = row["l_partkey"], row["l_returnflag"]
        return (F.when(flag == "N", F.format_string("[1, %d, %d]", part, row["l_linenumber"]))
                 .when(flag == "R", F.format_string('{"part": %d}', part)).otherwise(part.cast("string")))
    return _lines_of_orders(t, text).select(
        F.col("l_orderkey").alias("card_id"), F.col("lines").alias("rows"),
        F.array(*map(F.lit, ("part", "part", "line", "missing"))).alias("cols"))


def saved_queries(t: Tables) -> DataFrame:
    as_of = F.to_timestamp(F.lit(ORDERS_AS_OF))
    age = F.make_dt_interval(F.col("p_size"))
    return t.part.select(
        (F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("description"),
        F.lit("select 1").alias("query"), F.lit(None).cast("string").alias("created_at"),
        _iso(as_of - age).alias("updated_at"),
        F.when(F.col("p_size") % 2 != 0, F.lit('{"interval": 60}')).alias("schedule"),
        F.when(F.col("p_brand") != "Brand#1", F.struct(F.col("p_brand").alias("name"))).alias("user"),
        F.struct(F.lit("maker").alias("name")).alias("created_by"))


def fetched_queries(t: Tables) -> DataFrame:
    """Queries whose details could be read: all but one kind."""
    return t.part.where(F.col("p_type") != "LARGE").select((F.col("p_partkey") + 1).alias("id"))


def dashboards(t: Tables) -> DataFrame:
    return t.orders.select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.concat(F.lit("Weekly revenue and refunds overview of customer no. "),
                 F.col("o_custkey").cast("string")).alias("name"),
        F.concat(F.lit("d-"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.lit(None).cast("string").alias("created_at"), _iso(_time("o_orderdate")).alias("updated_at"),
        F.lit(None).cast("struct<name:string>").alias("user"),
        F.struct(F.col("o_orderpriority").alias("name")).alias("created_by"),
        F.when(F.col("o_orderstatus") == "P", True).alias("is_draft"),
        F.lit(None).cast("array<string>").alias("tags"))


def physical_tables(t: Tables) -> DataFrame:
    day = _time("o_orderdate")
    pick = F.col("o_orderkey") % 4
    suffix = (F.when(pick == 0, F.date_format(day, "'_'yyyyMMdd"))
               .when(pick == 1, F.date_format(day, "'_'yyyy_MM_dd"))
               .when(pick == 2, F.date_format(day, "'_'yyyyMM")).otherwise(""))
    return t.orders.select(
        F.when(F.col("o_orderstatus") == "O", "EU").otherwise("US").alias("region"),
        F.col("o_orderpriority").alias("table_schema"),
        F.concat(F.lit("orders_"), (F.col("o_custkey") % 50).cast("string"), suffix).alias("table_name"))


def datasets(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderpriority").alias("dataset_id"),
        F.when(F.col("o_orderstatus") == "O", "EU").when(F.col("o_orderstatus") == "F", "US")
         .alias("location")).distinct()


def tasks(t: Tables) -> DataFrame:
    due = _time("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    even, none = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7 == 0
    key = F.col("o_orderkey").cast("string")
    fields = F.array(
        F.struct(F.lit("Priority").alias("name"), F.col("o_orderpriority").alias("display_value"),
                 F.lit(None).cast("string").alias("text_value"),
                 F.lit(None).cast("double").alias("number_value")),
        F.struct(F.lit("Status").alias("name"), F.lit("").alias("display_value"),
                 F.nullif("o_orderstatus", F.lit("F")).alias("text_value"),
                 F.lit(None).cast("double").alias("number_value")),
        F.struct(F.lit("Size").alias("name"), F.lit(None).cast("string").alias("display_value"),
                 F.lit("").alias("text_value"),
                 (F.col("o_custkey") % 5).cast("double").alias("number_value")))
    return t.orders.select(
        key.alias("gid"), F.concat(F.lit("Task "), key).alias("name"),
        F.concat(F.lit("https://tasks.example/"), key).alias("permalink_url"),
        (F.col("o_orderstatus") == "F").alias("completed"),
        F.when(~none & even, F.date_format(due, "yyyy-MM-dd")).otherwise("").alias("due_on"),
        F.when(~none & ~even, _iso(due)).alias("due_at"),
        _iso(_time("o_orderdate")).alias("modified_at"),
        F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderpriority").alias("name")))
         .alias("assignee"),
        F.when(F.col("o_orderstatus") == "O", "inbox").alias("assignee_status"),
        F.col("o_custkey").alias("project_gid"),
        F.struct(F.col("o_custkey").cast("string").alias("gid"),
                 F.concat(F.lit("Project "), F.col("o_custkey").cast("string")).alias("name"))
         .alias("project_data"),
        fields.alias("custom_fields"))


def task_links(t: Tables) -> DataFrame:
    """Child rows of tasks: one per line item."""
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("gid"), F.col("l_partkey").alias("dependent"),
        F.col("l_suppkey").alias("dependency"), F.col("l_linenumber").alias("follower"),
        F.when(F.col("l_returnflag") == "A", "comment").otherwise("system").alias("type"),
        (F.col("l_quantity") > 25).alias("is_subtask"))


def subtasks(t: Tables) -> DataFrame:
    return t.customer.select(F.expr("c_custkey div 4").alias("parent_gid"),
                             (F.col("c_custkey") + 1).alias("child_gid"))


def repos(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("org"), F.col("s_suppkey").alias("repo"))


def _of_org(t: Tables, rows: DataFrame) -> DataFrame:
    """Attach the organisation of each line's repository."""
    return rows.join(repos(t), "repo")


def repo_files(t: Tables) -> DataFrame:
    folder = F.when(F.col("l_linenumber") == 1, ".git/").otherwise("src/f")
    tree = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 2)
    return _of_org(t, t.lineitem.select(
        F.col("l_suppkey").alias("repo"), F.when(tree, "tree").otherwise("blob").alias("type"),
        F.concat(folder, F.col("l_partkey").cast("string")).alias("path"),
        (F.col("l_extendedprice") * 2000).cast("long").alias("size")))


def pull_requests(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("repo"))
    text = F.col("o_orderkey").cast("string")
    found = lines.join(t.orders, "o_orderkey").select(
        "repo", F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("PR "), text)).alias("title"),
        F.concat(F.lit("https://git.example/"), text).alias("html_url"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise("dev").alias("author"),
        F.lit("topic").alias("head"), F.lit("main").alias("base"))
    return _of_org(t, found)


def commits(t: Tables) -> DataFrame:
    return _of_org(t, t.lineitem.select(
        F.col("l_suppkey").alias("repo"),
        F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber"), 256).alias("sha")))


def cards(t: Tables) -> DataFrame:
    kind = (F.when(F.col("p_type") == "PROMO", "Model").when(F.col("p_type") == "SMALL", "metric")
             .when(F.col("p_type") == "LARGE", F.lit(None)).otherwise("question"))
    return t.part.select(F.col("p_partkey").alias("id"), kind.alias("type"),
                         F.col("p_name").alias("name"))


def card_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_partkey").alias("card_id"), "l_orderkey", "l_linenumber", "l_suppkey",
        "l_extendedprice",
        F.concat(F.lit("["), F.concat_ws(", ", "l_orderkey", "l_linenumber"), F.lit("]")).alias("row"))


def dag_logs(t: Tables) -> DataFrame:
    dag = F.concat(F.lit("dag_"), F.col("user_id").cast("string"))
    task = F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))
    marked = F.concat(F.lit("Marking task as "), F.expr(LOG_STATE), F.lit(". dag_id="), dag,
                      F.lit(", task_id="), task, F.lit(", run_id=r1"))
    return t.events.select(
        _time("ts").alias("timestamp"), F.lit("INFO").alias("severity"),
        F.coalesce(marked, F.concat(F.lit("Heartbeat of task_id="), task)).alias("payload"),
        F.lit("projects/p/logs/airflow-worker").alias("log_name"),
        F.lit("cloud_composer_environment").alias("resource_type"),
        F.create_map(F.lit("environment_name"), F.concat(F.lit("env"), (F.col("user_id") % 2).cast("string")),
                     F.lit("location"), F.lit("eu")).alias("resource_labels"),
        dag.alias("dag_id"))


def metrics(t: Tables) -> DataFrame:
    counter = F.when(F.col("event_type") == "click", "task_requests_total").otherwise(
        F.concat(F.col("event_type"), F.lit("_seconds")))
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("gcp_"), F.col("event_type"))).otherwise(counter)
    labels = F.create_map(
        F.lit("user_email"), F.expr(USER_EMAIL),
        F.lit("region"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")),
        F.lit("instance_id"), F.concat(F.lit("i"), (F.col("user_id") % 5).cast("string")))
    return t.events.select(name.alias("metric"), labels.alias("labels"), _time("ts").alias("ts"), "value")


# Writes to the state hash of a task, by event type.
HASH_FIELD = """CASE event_type WHEN 'click' THEN 'state' WHEN 'purchase' THEN 'pr_url'
WHEN 'signup' THEN 'error' WHEN 'error' THEN 'task_json' ELSE 'started_at' END"""
HASH_VALUE = """CASE event_type
WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'queued' END
WHEN 'purchase' THEN 'https://git.example/pr/' || CAST(event_id AS STRING)
WHEN 'signup' THEN 'exit code ' || CAST(event_id % 9 AS STRING)
WHEN 'error' THEN '{"engine": "e' || CAST(event_id % 3 AS STRING) || '", "repo": "r", "instructions": "do"}'
ELSE CAST(event_id AS STRING) END"""
STAGE = """CASE event_type WHEN 'signup' THEN 'PLANNING' WHEN 'view' THEN 'WAIT_RFC'
WHEN 'click' THEN 'EXECUTING' WHEN 'purchase' THEN 'DONE' ELSE 'STOPPED' END"""


def task_hash_events(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("task_id"), _time("ts").alias("ts"), F.expr(HASH_FIELD).alias("field"),
        F.expr(HASH_VALUE).alias("value"))


def stage_events(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("task_id"), _time("ts").alias("ts"), "event_id",
                           F.expr(STAGE).alias("stage"))


def progress_json(t: Tables) -> DataFrame:
    """Event JSON: clicks are progress ticks, all others stage changes."""
    tick = F.to_json(F.struct(F.lit("tick").alias("type"),
                              (F.col("event_id") % 250).alias("progress")))
    stage = F.to_json(F.struct(F.lit("stage").alias("type"), F.expr(STAGE).alias("stage"),
                               F.lit("RUNNING").alias("status")))
    return t.events.select(F.col("user_id").alias("task_id"), _time("ts").alias("ts"),
                           F.when(F.col("event_type") == "click", tick).otherwise(stage).alias("value"))


def feedback(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("document_id"), "turn", F.col("text").alias("body"))


def task_documents(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("version"),
                                  F.col("role").alias("kind"), F.col("text").alias("body"))
