"""Fixed and varying files, relative numbers, file sorts, print lines, record stores, codecs and moves."""

import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import moves
from ledgerframe.picture import PACKED, Field, Layout, picture
from ledgerframe.sources import files, registry
from ledgerframe.sources.store import RecordStore

LAYOUT = Layout.of("R", Field("K", picture("9(3)")), Field("V", picture("S9(3)V99"), PACKED), Field("T", picture("X(4)")))


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(10).selectExpr("cast(id as decimal(3,0)) K", "cast(id * 1.5 - 3 as decimal(5,2)) V", "concat('t', id, '  ') T").repartitionByRange(3, "K")


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("encoding", [None, "cp037"])
def test_fixed_and_varying(spark, data, tmp_path, encoding):
    want = found(data.withColumn("T", F.rpad("T", 4, " ")))
    files.write_fixed(data, f"{tmp_path}/f", LAYOUT, encoding)
    assert found(files.read_fixed(spark, f"{tmp_path}/f", LAYOUT, encoding)) == want
    files.write_fixed(data, f"{tmp_path}/f", LAYOUT, encoding, mode="append")
    assert files.read_fixed(spark, f"{tmp_path}/f", LAYOUT, encoding).count() == 20
    files.write_fixed(data, f"{tmp_path}/f", LAYOUT, encoding)
    assert files.read_fixed(spark, f"{tmp_path}/f", LAYOUT, encoding).count() == 10
    files.write_variable(data, f"{tmp_path}/v", LAYOUT, encoding)
    assert found(files.read_variable(spark, f"{tmp_path}/v", LAYOUT, encoding)) == want


def test_empty_short_and_missing(spark, data, tmp_path):
    files.write_fixed(data.limit(0), f"{tmp_path}/e", LAYOUT)
    assert files.read_fixed(spark, f"{tmp_path}/e", LAYOUT).count() == 0
    (tmp_path / "s").write_bytes(b"001\x00\x10\x0cab  00")
    assert found(files.read_fixed(spark, f"{tmp_path}/s", LAYOUT)) == [(Decimal(0), Decimal("202.02"), "    "), (Decimal(1), Decimal("1.00"), "ab  ")]  # a packed number of blanks is its digits
    assert files.read_fixed(spark, f"{tmp_path}/s", LAYOUT, partial="drop").count() == 1
    assert files.status(f"{tmp_path}/s") == "00" and files.status(f"{tmp_path}/no") == "35"


def test_relative_numbers_over_splits(spark, tmp_path):
    layout = Layout.of("N", Field("N", picture("9(4)")))
    (tmp_path / "r").mkdir()
    for part in range(3):
        (tmp_path / "r" / f"p{part}").write_text("".join(f"{part * 100 + i:04}" for i in range(100)))
    files.register(spark)
    raw = spark.read.format("fixedrec").options(recordLength=4, split=40).load(f"{tmp_path}/r")
    assert raw.rdd.getNumPartitions() == 30
    assert raw.where("rrn - 1 <> cast(cast(value as string) as int)").count() == 0
    assert [tuple(r) for r in files.read_relative(spark, f"{tmp_path}/r", layout).where("rrn = 205").collect()] == [(205, Decimal(204))]


def test_sort_merge_rewrite(spark, data, tmp_path):
    files.write_fixed(data, f"{tmp_path}/a", LAYOUT)
    files.rewrite_file(spark, f"{tmp_path}/a", f"{tmp_path}/b", LAYOUT, lambda df: df.withColumn("T", F.lit("new")))
    files.sort_file(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/c", LAYOUT, ("K", "desc"))
    got = files.read_relative(spark, f"{tmp_path}/c", LAYOUT).orderBy("rrn").collect()
    assert [int(r.K) for r in got] == [k for k in range(9, -1, -1) for _ in "ab"] and [r.T for r in got[:2]] == ["t9  ", "new "]


def test_advancing(spark):
    df = spark.createDataFrame([("a",)], "line string")
    assert [r[0] for r in files.advanced(df, "line", 3).collect()] == ["", "", "a"]
    assert [r[0] for r in files.advanced(df, "line", 2, after=False).collect()] == ["a", ""]


def test_store(spark, data, tmp_path):
    s = RecordStore(spark, f"{tmp_path}/s", LAYOUT, "K")
    assert s.count() == 0 and s.version() is None
    assert s.insert(data).count() == 0 and s.insert(data.limit(2)).count() == 2 and s.count() == 10
    assert s.insert(data.limit(1).withColumn("K", F.lit(77).cast("decimal(3,0)")).crossJoin(spark.range(2)).drop("id")).count() == 1
    s.delete(data.where("K < 4"))
    s.update(data.where("K = 5").withColumn("T", F.lit("five")))
    s.upsert(data.where("K in (1, 6)").withColumn("T", F.lit("up")))
    assert s.count() == 8 and s.find_by_key(5).first().T.strip() == "five" and s.find_where("T = :T", T="up").count() == 2
    wider = RecordStore(spark, s.path, Layout.of("R", *LAYOUT.fields, Field("N", picture("9(2)"))), "K")
    assert wider.migrate(lambda df: df.withColumn("N", F.lit(7).cast("decimal(2,0)"))) and not wider.migrate()
    assert wider.find_all().where("N = 7").count() == 8
    wider.drop_all()
    assert wider.count() == 0


@pytest.mark.parametrize("name", ["json", "xml", "fixed", "ebcdic"])
def test_codecs(spark, data, name):
    got = registry.decode(name, registry.encode(name, data, LAYOUT), LAYOUT)
    assert found(got.withColumn("T", F.trim("T"))) == found(data.withColumn("T", F.trim("T")))


def test_moves(spark):
    layout = Layout.from_copybook("01 R.\n 05 A PIC X(2). 88 GOOD VALUE 'OK' 'YES'.\n 05 N PIC S9(3). 05 T PIC 9(2) OCCURS 3.")
    df = moves.initialized(spark.range(1), layout).withColumn("A", moves.set_true(layout.field("A"), "GOOD"))
    assert tuple(df.select("A", "N", "T").first()) == ("OK", 0, [0, 0, 0])
    t = F.array(F.lit(1), F.lit(2))
    got = spark.range(1).select(moves.element(t, 3), moves.set_element(t, 2, F.lit(9)), moves.character_wise(F.lit("ab"), F.upper)).first()
    assert tuple(got) == (None, [1, 9], "AB")
    x = spark.createDataFrame([(Decimal(990), Decimal(5), Decimal(20))], "N decimal(3,0), N2 decimal(3,0), s_N decimal(3,0)")
    assert moves.corresponding(x, layout, layout, "ADD", "s_").first().N == 990  # size error: unchanged
    assert moves.corresponding(x, layout, layout, "SUBTRACT", "s_").first().N == 970
    assert all(len(r) == n for r, n in zip(spark.range(1).select(*map(moves.accept, ("DATE", "DAY", "DAY-OF-WEEK", "TIME"))).first(), (6, 5, 1, 8)))


def test_jdbc(spark, data, tmp_path):
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no database driver at hand")
    from ledgerframe.sources.jdbc import Connection

    c = Connection(spark, f"jdbc:derby:{tmp_path}/db;create=true", options={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    c.write(data.selectExpr("cast(K as int) K", "V"), "T1", mode="overwrite")
    assert c.table("T1", "K", (0, 10), 3).count() == 10 and c.query("select K from T1 where K < 4").count() == 4
    c.view("T1", "t_jdbc")
    assert spark.sql("select sum(V) from t_jdbc").first()[0] == Decimal("37.50")


def test_jdbc_on_executors(tmp_path):
    """Executors are other processes: what they read isn't in the driver's memory."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from ledgerframe.plans import QUERIES
from ledgerframe.sources.jdbc import embedded
got = QUERIES["jdbc_table"](spark, "/root/testdata/sf0.001")
print("query", sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").where("s_nationkey < 10").selectExpr("s_suppkey", "s_name", "cast(s_acctbal as decimal(11,2))").collect())), got.count())
rows = [(1, 'a "b", c'), (2, None), (3, ""), (4, "two\\nlines, \u00e9"), (None, "x")]
x = spark.createDataFrame(rows, "K long, T string")
print("odd", sorted(map(tuple, embedded(x, "T1", "file://{tmp_path}/shared/a").table("T1").repartition(2).collect()), key=str) == sorted(rows, key=str))
print("none", embedded(x.limit(0), "T1", "file://{tmp_path}/shared/b").table("T1").count())
"""
    home = tmp_path / "home"  # executors work in Spark's home
    home.mkdir()
    for x in Path(pyspark.__file__).parent.iterdir():
        if x.name != "work":
            (home / x.name).symlink_to(x)
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [x.split()[:2] for x in run.stdout.splitlines()[-3:]] == [["query", "True"], ["odd", "True"], ["none", "0"]], run.stdout + run.stderr[-3000:]
