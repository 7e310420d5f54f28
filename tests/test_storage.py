import subprocess
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill import storage
from corpusmill.functions import temporal
from corpusmill.functions import text as T
from corpusmill.operators import answers
from corpusmill.session import BATCH_BYTES


def test_a_local_warehouse_is_refused_on_a_cluster():
    with pytest.raises(ValueError):
        storage._fallback(False, "file:/user/warehouse")
    with pytest.raises(ValueError):
        storage._fallback(False, "/user/warehouse")
    assert storage._fallback(False, "hdfs://x/warehouse/") == "hdfs://x/warehouse/_corpusmill"
    assert storage._fallback(True, "file:/x").endswith("corpusmill-shared")


def test_tables_are_read_as_they_lie(spark):
    plan = storage.table(spark, "/root/testdata/sf0.1", "documents")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bounded_counts_rows_and_bytes(spark):
    rows = spark.createDataFrame([(1, "x" * 100), (2, None)], "a int, b string")
    assert storage.is_broadcast(storage.bounded(rows, 2)) and not storage.is_broadcast(storage.bounded(rows, 1))
    assert not storage.is_broadcast(storage.bounded(rows, 2, most_bytes=100))


def test_free_names():
    class Frame:
        columns = ["row", "ROW_", "x.y"]

    assert storage.free_names(Frame, "row", "row", "k") == ["row__", "row___", "k"]


def test_numbered(spark):
    rows = spark.range(50).select((F.col("id") * 37 % 50).alias("v"), F.lit("p").alias("part"))
    got = storage.numbered(rows, "v", "place").collect()
    assert {r.v + 1 for r in got} == set(range(1, 51)) and all(r.place == r.v + 1 and r.part == "p" for r in got)
    assert storage.numbered(rows.limit(0), "v", "place").count() == 0


def test_space(spark, tmp_path):
    assert storage.check_space(spark, str(tmp_path / "not/there"), 1) > 0
    with pytest.raises(RuntimeError):
        storage.check_space(spark, str(tmp_path), 1 << 62)


def test_batches_are_bounded_by_bytes(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == BATCH_BYTES


def test_only_the_absence_of_the_subpackage_is_tolerated(tmp_path):
    code = "import sys; sys.path.insert(0, {!r}); import corpusmill; sys.modules.pop('zstandard', None); sys.modules['zstandard'] = None; import __spark_entry__"
    root = storage.__file__.rsplit("/", 2)[0]
    done = subprocess.run([sys.executable, "-c", code.format(root)], capture_output=True, text=True, cwd=tmp_path)
    import importlib.util

    there = importlib.util.find_spec("corpusmill.llm")
    assert (done.returncode != 0 and "zstandard" in done.stderr) == bool(there and there.origin)


ODD = ["ά й Ἀ ﬁ ² １８１０ 25％ ½ ™ é ß", "한글 텍스트", "क्षि", "℃ ﷺ", "plain", "", "ẹ́", "ᅡ각"]


def test_unicode_forms(spark):
    rows = spark.createDataFrame([(t,) for t in [*ODD, None]], "t string").select("t", T.unaccented(F.col("t")).alias("a"), T.compatible(F.col("t")).alias("c"), T.slug(F.col("t")).alias("s")).collect()
    for r in rows:
        if r.t is None:
            assert r.a is None and r.c is None
            continue
        assert r.a == "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c))
        assert r.c == unicodedata.normalize("NFKC", r.t)
    assert spark.createDataFrame([("ﬁn Ångström",)], "t string").select(T.slug(F.col("t"))).first()[0] == "fin-angstrom"


def test_claims_in_other_forms(spark):
    rows = [(1, "En １８１０ subió 25％.", "En 1810 subió 25 %."), (2, "En 1810", "en １８１０"), (3, "En 1811", "en １８１０"), (4, "siglo XIX", "SIGLO ⅩⅨ")]
    got = answers.unsupported(spark.createDataFrame(rows, "answer_id long, answer string, source string")).collect()
    assert {r.answer_id for r in got} == {3}
    assert spark.range(1).select(temporal.normalized(F.lit("Straße ΟΔΟΣ – 5 ％"))).first()[0] == "strasse οδοσ - 5%"
