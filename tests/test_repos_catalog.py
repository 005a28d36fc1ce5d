import os

from pyspark.sql import functions as F

from tallyloom.functions import predicates as P
from tallyloom.operators import catalog as C
from tallyloom.operators import repos as R
from tallyloom.schemas import COMMITS, PULL_REQUESTS, REPO_FILES, REPOS
from tallyloom.sources import scans

MIB100 = 100 * 1024 * 1024


def test_repository_names_and_defaults(spark):
    rows = [("o", "n", "s", "o/f", None, None, None, True, None, "u"), ("o", "n", "", "o/f", "dev", 5, False, None, True, "u"),
            ("o", None, None, "o/f", "", 1, None, None, None, "u"), ("o", None, None, None, None, 1, None, None, None, "u")]
    df = spark.createDataFrame(rows, REPOS)
    got = R.repositories(df).collect()
    assert [r.repo for r in got] == ["s", "n", "f"]
    assert [(r.size, r.default_branch, r.fork, r.private) for r in got] == [
        (0, "main", False, True), (5, "dev", False, False), (1, "main", False, False)]
    assert R.valid_repositories(df).count() == 2


def test_file_rule(spark):
    rows = [("o", "r", "blob", p, s) for p, s in [
        ("a", 1), ("", 1), (None, 1), ("b", None), ("c", MIB100), ("d", MIB100 + 1), (".git/x", 1), ("a/.git/x", 1),
        ("a/.github/x", 1), ("x.git/y", 1)]] + [("o", "r", "tree", "t", 1)]
    df = spark.createDataFrame(rows, REPO_FILES)
    assert sorted(r.path for r in R.countable_files(df).collect()) == ["a", "a/.github/x", "c", "d", "x.git/y"]
    assert sorted(r.path for r in R.countable_files(df, MIB100).collect()) == ["a", "a/.github/x", "c", "x.git/y"]
    assert [tuple(r) for r in R.oversized_files(df, MIB100).collect()] == [("o", "r", 1)]


def test_each_part_of_a_pull_request_is_needed(spark):
    good = ("o", "r", 1, "t", "h", "a", "x", "main")
    rows = [good] + [good[:i] + (None,) + good[i + 1:] for i in range(2, 8)] + [
        good[:i] + ("",) + good[i + 1:] for i in range(3, 8)]
    assert R.pull_request_counts(spark.createDataFrame(rows, PULL_REQUESTS)).first().prs == 1


def test_metrics_and_summaries(spark):
    repos = spark.createDataFrame([("o", "r"), ("o", "empty"), ("o", "bad")], "org string, repo string")
    files = spark.createDataFrame([("o", "r", "blob", f"f{i}", 1) for i in range(4)], REPO_FILES)
    prs = spark.createDataFrame([("o", "r", 1, "t", "h", "a", "x", "main")], PULL_REQUESTS)
    commits = spark.createDataFrame([("o", "r", "s1"), ("o", "r", "s1"), ("o", "r", "s2")], COMMITS)
    failures = spark.createDataFrame([("o", "bad", "timeout")], "org string, repo string, message string")
    metrics = R.repo_metrics(repos, files, prs, commits, failures)
    got = {r.repo: (r.files, r.prs, r.commits, r.error) for r in metrics.collect()}
    assert got == {"r": (4, 1, 2, None), "empty": (0, 0, 0, None), "bad": (0, 0, 0, "timeout")}
    assert R.repo_totals(metrics).first() == (3, 4, 1, 2)
    assert R.organisation_summary(metrics).first() == (3, 4, 1, 2, 1, 1, 1, 1.33, 0.33, 0.67)
    assert R.active_share(metrics).first() == (1, 3, 33.3, 1.3, 0.3, 0.7)
    assert [r.repo for r in R.by_activity(metrics).collect()][0] == "r"
    assert R.organisation_summary(metrics.where("false")).first().avg_files_per_repo == 0.0


def test_text_files(spark, folder):
    files = {"a.txt": b"\x00", "b": b"plain text\r\n", "c": b"", "d": b"x\x00y", "e": b"\xff" * 2 + b"a" * 8,
             "f": b"\xff" + b"a" * 10, "g": b"a" * 512 + b"\x00" * 600, "h.JSON": b"\xff" * 9, ".git/k": b"text",
             "sub/.git/k": b"text", "_n": b"text", "empty.py": b"", "p.txt.gz": b"\xff" * 9, "q.gz": b"\xff" * 9, "sub/.github/o": b"text", "sub/m": "café au lait, s'il vous plait".encode()}
    for name, data in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(data)
    found = scans.walk_files(spark.createDataFrame([(folder,)], "root string"))
    assert found.count() == 14
    names = sorted(r.path.rsplit("/", 1)[1] for r in R.text_files(found).collect())
    assert names == ["_n", "a.txt", "b", "empty.py", "f", "h.JSON", "m", "o", "p.txt.gz"]
    probed = found.where(P.looks_like_text(F.col("content"), 512) & F.col("path").endswith("/g"))
    assert probed.count() == 1  # NUL bytes come after the probe
    # Spark's file source leaves out empty files and hidden names.
    heads = scans.read_file_heads(spark, folder)
    assert sorted(r.path.rsplit("/", 1)[1] for r in R.text_files(heads).collect()) == [
        "a.txt", "b", "f", "h.JSON", "m", "p.txt.gz"]


def test_card_kinds_and_samples(spark):
    kinds = ["model", "METRIC", None, "question", "other"]
    df = spark.createDataFrame([(i, kinds[i % 5], f"n{i}") for i in range(40)], "id long, type string, name string")
    assert C.card_counts(df).first() == (40, 24, 8, 8)
    assert C.sample_cards(df, ["id"], 1).count() == 3  # the argument is honoured
    sample = C.sample_cards(df, ["id"], 2)
    assert sorted((r.artifact, r.id) for r in sample.collect()) == [
        ("cards", 2), ("cards", 3), ("metrics", 1), ("metrics", 6), ("models", 0), ("models", 5)]
    plan = C.sample_cards(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # also below the shuffle


def test_result_samples(spark):
    rows = ['["a", 1]', '["b"]', '{"x": "y"}', "7", '["c", 2, 3]']
    df = spark.createDataFrame([(1, ["n", "n", "m"], rows), (2, [], ["[1]"]), (3, ["n"], [])],
                               "card_id long, cols array<string>, rows array<string>")
    got = {r.card_id: r for r in C.sample_results(df, 4).collect()}
    assert got[1].rows == [{"n": "1", "m": None}, {"n": None, "m": None}, {"x": "y"}, {"_value": "7"}]
    assert [got[i].row_count_sampled for i in (1, 2, 3)] == [4, 1, 0]
    assert got[2].rows == [{}] and got[3].rows == []
    lists = spark.createDataFrame([(1, ["n", "m"], [["a", "1"], ["b"]], None), (2, ["n"], None, "timeout"),
                                   (3, ["n"], None, None)],
                                  "card_id long, cols array<string>, rows array<array<string>>, error string")
    got = {r.card_id: r for r in C.sample_results(lists).collect()}
    assert got[1].rows == [{"n": "a", "m": "1"}, {"n": "b", "m": None}] and got[1].data_error is None
    assert [(got[i].row_count_sampled, got[i].data_error) for i in (2, 3)] == [(0, "timeout"), (0, "no result")]


def test_predicates(spark):
    df = spark.createDataFrame([(None,), ("",), ("p.d.T_TEMP_x",), ("p.Scratch.t",), ("p.d.temp_1",), ("p.d.t",)], "v string")
    assert [r[0] for r in df.select(P.is_temporary_write(F.col("v"))).collect()] == [False, False, True, True, True, False]
    mails = spark.createDataFrame([("a@B.IAM.gserviceaccount.COM",), ("a@iam.gserviceaccount.com.x",), (None,)], "v string")
    assert [r[0] for r in mails.select(P.is_service_account(F.col("v"))).collect()] == [True, False, False]
    kinds = spark.createDataFrame([("create_table_as_select",), ("CREATE_TABLE",), ("insert",), (None,)], "v string")
    assert [r[0] for r in kinds.select(P.is_dml(F.col("v"))).collect()] == [True, False, True, False]
    states = spark.createDataFrame([("RUNNING:7",), ("RUNNING",), ("RUNNING:x",), (None,)], "v string")
    assert [r[0] for r in states.select(P.progress_of(F.col("v"))).collect()] == [7, 0, 0, 0]
