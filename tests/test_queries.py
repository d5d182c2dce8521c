"""Every query that has SQL against DuckDB; the entry; files, SQL sessions and ports."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerframe import plans
from ledgerframe.picture import Field, Layout, picture
from ledgerframe.sources import files
from ledgerframe.sql import Session
from ledgerframe.streaming.ports import Queues, Region, delivered, listen

SF = "/root/testdata/sf0.001"


def rows(table):
    plain = lambda v: "null" if v is None else str(float(v)) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(plain, r)) for r in table)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(plans.SQL[name])
    assert columns == sorted(want.columns)
    assert rows(got.select(columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_files(spark, tmp_path):
    layout = Layout.of("R", Field("A", picture("X(3)")), Field("N", picture("9(2)")))
    (tmp_path / "f").write_bytes(b"abc01de 22")
    assert [tuple(r) for r in files.read_fixed(spark, str(tmp_path / "f"), layout).collect()] == [("abc", 1), ("de ", 22)]
    (tmp_path / "v").write_bytes(b"\0\x09\0\0abc01\0\x07\0\0xyz")
    assert [tuple(r) for r in files.read_variable(spark, str(tmp_path / "v"), layout).collect()] == [("abc", 1), ("xyz", 0)]
    x = files.read_fixed(spark, str(tmp_path / "f"), layout)
    files.write_lines(x, str(tmp_path / "l"), layout)
    assert sorted(map(tuple, files.read_lines(spark, str(tmp_path / "l"), layout).collect())) == [("abc", 1), ("de ", 22)]


def test_session(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").createOrReplaceTempView("t_session")
    s = Session(spark, strict=True)
    assert s.select_into("select v into :V from t_session where k = :K-1", k_1=2).value.v == "b"
    assert s.select_into("select v into :V from t_session where k = :K", k=9).code == 100
    assert s.select_into("select v into :V from t_session").code == -811
    assert s.update("t_session", "k = 9", v="'z'").code == 100
    s.delete("t_session", "k = 1")
    s.rollback()
    assert spark.table("t_session").count() == 2
    s.declare("C", "select k from t_session where v >= :LOW order by k")
    s.open("C", low="a")
    assert [s.fetch("C").value.k, s.fetch("C").value.k, s.fetch("C").code] == [1, 2, 100]


def test_ports_and_regions(spark, tmp_path):
    spark.createDataFrame([("A", "x"), ("B", "y"), ("Z", "q")], "trans_id string, commarea string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trans_id string, commarea string").parquet(str(tmp_path / "in"))
    region, got = Region(), []
    region.register("A", lambda df: df.withColumn("commarea", F.upper("commarea")))
    region.register("B", lambda df: df)
    listen(stream, lambda b: got.extend(map(tuple, region.dispatch(b).collect())), str(tmp_path / "c"), "exactly once").awaitTermination()
    assert sorted(got) == [("A", "X", "NORMAL"), ("B", "y", "NORMAL"), ("Z", "q", "TRANSIDERR")]


def test_delivery_modes_and_queues(spark, tmp_path):
    spark.range(6).selectExpr("id", "concat('m', id) text").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    tries = []

    def flaky(batch):
        tries.append(batch.count())
        if len(tries) < 3:
            raise RuntimeError("again")

    listen(stream(), flaky, f"{tmp_path}/c1", pause=0).awaitTermination()
    assert tries == [6, 6, 6]
    listen(stream(), lambda b: 1 / 0, f"{tmp_path}/c2", "fire and forget").awaitTermination()
    for _ in range(2):  # the second start finds nothing new
        delivered(stream(), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    q = Queues(spark)
    q.write(spark.createDataFrame([("A", 2, "y"), ("A", 1, "x"), ("B", 1, "z")], "queue string, seq int, data string"))
    q.write(spark.createDataFrame([("A", 1, "w")], "queue string, seq int, data string"))
    assert [r.data for r in q.browse("A", 1).collect()] == ["y", "w"] and q.read("A", 1).first().data == "x"
    q.delete("A")
    assert [tuple(r) for r in q.depth().collect()] == [("B", 1)]


def test_link_and_conditions(spark):
    region = Region()
    region.define("UP", lambda df: df.withColumn("commarea", F.upper("commarea")))
    region.register("A", lambda df: region.link("UP", df))
    region.register("B", lambda df: region.link("NONE", df))
    region.resources["CUST"] = spark.createDataFrame([("x", 1)], "commarea string, n int")
    region.register("C", lambda df: region.read_file(df, "CUST", "commarea"))
    region.register("D", lambda df: region.read_file(df, "NOPE", "commarea"))
    df = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x"), ("C", "y"), ("D", "x"), (None, "q")], "trans_id string, commarea string")
    got = sorted((r.commarea, r.condition) for r in region.dispatch(df).collect())
    assert got == sorted([("X", "NORMAL"), ("x", "PGMIDERR"), ("x", "NORMAL"), ("y", "NOTFND"), ("x", "FILENOTFOUND"), ("q", "TRANSIDERR")])
