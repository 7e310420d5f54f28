"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in entry.queries().keys() - entry.oracle_sql().keys() if not k.startswith("op") and k != "pipeline"))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_audit_and_evaluation_on_literals(spark):
    from corpusmill.operators import audit
    from corpusmill.settings import Settings

    u = lambda *x: spark.createDataFrame([(i,) for i in x], "url string")
    states = audit.url_states(u("a", "b", "c", "c"), u("a", "z"), u("b"))
    assert [r.url for r in audit.missing(states).collect()] == ["c"] and [r.url for r in audit.stale(states).collect()] == ["z"]
    site = f"https://{Settings().site}"
    objects = spark.createDataFrame([(f"{site}/a", "x"), (f"{site}/b", "y")], "root_url string, subject_slug string")
    documents = spark.createDataFrame([("x", True), ("y", True), ("z", False)], "subject string, active boolean")
    states = audit.url_states(u(f"{site}/a/1", f"{site}/b/1"), u(f"{site}/a/1"), u(f"{site}/b/1"))
    stats = spark.createDataFrame([(1, 1, 1)], "documents long, chunks long, embedded_chunks long")
    row = audit.summary(objects, u(f"{site}/a/1", f"{site}/b/1", f"{site}/b/1"), states, documents, stats, Settings()).first()
    assert row.indexed_subjects == 2 and row.objects_with_pages == 2
    assert row.complete and row.duplicate_urls == 1 and (row.indexed_pages, row.skipped_pages) == (1, 1)
    cases = spark.createDataFrame([(0, "a", True), (1, "q", True), (2, None, False)], "qid long, expected string, should_answer boolean")
    hits = spark.createDataFrame([(0, "x/a"), (1, "x/b"), (2, "x/c")], "qid long, url string")
    gate = spark.createDataFrame([(0, True), (1, True), (2, False)], "qid long, sufficient boolean")
    row = audit.evaluation(audit.case_results(cases, hits, gate)).first()
    assert (row.total, row.passed, row.retrieval_recall, row.refusal_accuracy, row.failures) == (3, 2, 0.5, 1.0, [1])
    assert tuple(audit.evaluation(audit.case_results(cases.limit(0), hits, gate)).first())[:4] == (0, 0, 0.0, 0.0)


def test_cases_from_json(spark, tmp_path):
    from corpusmill.operators import audit

    (tmp_path / "c.json").write_text('[{"question": "q", "expected_url_contains": "u", "should_answer": true}, {"question": "r", "should_answer": false}]')
    rows = audit.load_cases(spark, str(tmp_path / "c.json")).collect()
    assert [(r.question, r.expected_url_contains, r.should_answer) for r in rows] == [("q", "u", True), ("r", None, False)]
