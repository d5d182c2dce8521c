"""Verbs, files, ports and sessions beyond what the named queries show."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerframe.cobol import Program, UnsupportedVerbError
from ledgerframe.functions import conditions, numeric, strings
from ledgerframe.operators import records
from ledgerframe.picture import Field, Layout, picture
from ledgerframe.plans.verbs import _program
from ledgerframe.sources import files, folders, store
from ledgerframe.sql import Session
from ledgerframe.streaming.ports import Port, Region, listen


def test_sort_keeps_equal_records_in_order(spark):
    x = spark.range(1000).select("id", (F.col("id") % 3).alias("k")).repartition(5, "id").sortWithinPartitions("id").cache()
    order = [r.id for r in x.collect()]
    got = [(r.k, r.id) for r in records.sort(x, ("k", "desc"), in_order=True).collect()]
    assert got == [(k, i) for k in (2, 1, 0) for i in order if i % 3 == k]
    x.unpersist()


def test_table_sort_and_range_search(spark):
    t = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(2, "x"), (1, "y"), (2, "w"), (1, "z")]))
    got = spark.range(1).select(records.sort_table(t, ("a", "desc")).alias("t"), records.sort_table(F.array(F.lit(3), F.lit(1))).alias("n")).first()
    assert [tuple(x) for x in got.t] == [(2, "x"), (2, "w"), (1, "y"), (1, "z")] and got.n == [1, 3]
    table = spark.createDataFrame([(0, 9, "low"), (5, 24, "middle"), (20, 40, "high")], "low long, high long, name string")
    rows = spark.createDataFrame([(0,), (7,), (9,), (22,), (40,), (41,), (None,)], "v long")
    for width in (1, 7, 100):
        got = {r.v: r.name for r in records.search_range(rows, table, "v", "low", "high", width).collect()}
        assert got == {0: "low", 7: "low", 9: "low", 22: "middle", 40: "high", 41: None, None: None}


def test_keyed_verbs_with_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 3)], "k int, v string, seq int")
    after, rejects = records.write_keyed(old.withColumn("seq", F.lit(0)), new, "k", "seq")
    assert sorted((r.k or 0, r.v) for r in after.collect()) == [(0, "n"), (1, "a"), (2, "b"), (3, "y")]
    assert sorted((r.k, r.v) for r in rejects.collect()) == [(2, "x"), (3, "z")]
    got = records.rewrite(old, spark.createDataFrame([(2, "p", 2), (2, "q", 1), (9, "r", 1), (None, "s", 1)], "k int, v string, seq int"), "k", "seq")
    assert sorted((r.k or 0, r.v) for r in got.collect()) == [(0, "n"), (1, "a"), (2, "p")]


def test_conditions_and_size_errors_by_functions(spark):
    f = conditions.with_condition(Field("N", picture("9(3)"), conditions=(("ONE", ("1",)),)), "ODD", lambda x: x % 2 == 1)
    x = spark.createDataFrame([(Decimal(1),), (Decimal(5),), (Decimal(1000),)], "n decimal(5,0)")
    n = F.col("n")
    got = x.select(conditions.level88(f, "ONE", n), conditions.level88(f, "ODD", n), numeric.stored(n, "9(3)", on_error=lambda v: v % 1000 + 7)).collect()
    assert [tuple(r) for r in got] == [(True, True, 1), (False, True, 5), (False, False, 7)]
    log = numeric.tracked(numeric.tracked(x, n=n + 1), n=n).select("changes").first().changes
    assert [tuple(c) for c in log] == [("n", "1", "2")]


def test_unstring_from_a_pointer(spark):
    t = F.lit("aa,b;cc")
    for pointer, want in ((1, (["aa", "b"], [",", ";"], 6, True)), (4, (["b", "cc"], [";"], 8, False)), (9, ([None, None], [], 9, True)), (0, ([None, None], [], 0, True))):
        got = spark.range(1).select(*strings.unstring_from(t, 2, ",", ";", pointer=pointer)).first()
        assert tuple(got) == want


def test_record_file_states(spark, tmp_path):
    layout = Layout.of("R", Field("K", picture("9(3)")), Field("T", picture("X(2)")))
    f = files.RecordFile(spark, f"{tmp_path}/f", layout)
    assert f.open("INPUT") == "35" and f.close() == "41"
    with pytest.raises(OSError):
        f.read()
    assert f.open("OUTPUT") == "00" and f.open("INPUT") == "41"
    assert f.write(spark.sql("select cast(1 as decimal(3,0)) K, 'é' T")) == "00" and f.close() == "00"
    assert f.open("INPUT") == "00" and [tuple(r) for r in f.read().collect()] == [(1, 1, "é ")] and f.write(f.read()) == "37"


def test_varying_records_of_many_sizes(spark, tmp_path):
    files.register(spark)
    values = [b"", b"a", b"x" * 300, bytes(range(256)) * 100]
    df = spark.createDataFrame([(None, v) for v in values], "rrn long, value binary").coalesce(1)
    df.write.format("fixedrec").options(recordLength=0, format="VB").mode("overwrite").save(f"{tmp_path}/v")
    assert [bytes(r.value) for r in spark.read.format("fixedrec").options(recordLength=0, format="VB").load(f"{tmp_path}/v").collect()] == values
    with pytest.raises(Exception, match="varying record"):
        spark.createDataFrame([(None, b"x" * 40_000)], "rrn long, value binary").write.format("fixedrec").options(recordLength=0, format="VB").mode("overwrite").save(f"{tmp_path}/w")


def test_create_table_by_dialect():
    layout = Layout.from_copybook("01 R.\n 05 K PIC 9(4). 05 G. 10 N PIC 9(9). 10 B PIC 9(18). 05 D PIC S9(7)V99 COMP-3. 05 T PIC X(20). 05 R2 REDEFINES T PIC X(20).")
    assert store.ddl(layout, "K", "oracle") == "CREATE TABLE R (K NUMBER(5) NOT NULL, N NUMBER(10), B NUMBER(19), D NUMBER(9,2), T VARCHAR2(20), PRIMARY KEY (K))"
    assert store.dialect("jdbc:postgresql://h/db") == "postgresql" and store.dialect("jdbc:other:x") == "h2"


def test_session_survives_what_was_not_committed(spark, tmp_path):
    at = str(tmp_path / "s")
    spark.createDataFrame([(1,)], "k int").createOrReplaceTempView("t_durable")
    s = Session(spark, folder=at)
    s.insert("t_durable", spark.sql("select 2 k"))
    s.commit()
    s.insert("t_durable", spark.sql("select 3 k"))
    s.staged["t_durable"].write.parquet(f"{at}/commit-000000002/t_durable")  # a commit that ended before its mark
    spark.catalog.dropTempView("t_durable")
    again = Session(spark, folder=at)
    assert sorted(r.k for r in spark.table("t_durable").collect()) == [1, 2]
    again.delete("t_durable", "k = 1")
    again.commit()
    assert folders.children(spark, at) == ["commit-000000001", "commit-000000002", "commit-000000003"]
    Session(spark, folder=at)
    assert [r.k for r in spark.table("t_durable").collect()] == [2]


def test_port_loses_nothing_it_should_keep(spark, tmp_path):
    port = Port(spark, str(tmp_path / "p"))
    assert port.receive() is None
    for i in range(3):
        port.send(spark.createDataFrame([(f"m{i}",)], "text string"))
    with pytest.raises(ZeroDivisionError):
        port.work(lambda df: 1 / 0, "exactly once")
    assert len(port.waiting()) == 3 and port.receive().first().text == "m0"
    port.ack()
    other, seen = Port(spark, str(tmp_path / "p")), []
    other.send(spark.createDataFrame([("m3",)], "text string"))
    assert other.work(lambda df: seen.append(df.first().text)) == 3 and seen == ["m1", "m2", "m3"] and other.waiting() == []


def test_exactly_once_over_restarts(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    stream, done = (lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")), []
    listen(stream(), lambda b: done.append(b.count()), f"{tmp_path}/c", "exactly once").awaitTermination()
    for f in (tmp_path / "c" / "commits").iterdir():  # as if the driver had ended before the commit
        f.unlink()
    listen(stream(), lambda b: done.append(b.count()), f"{tmp_path}/c", "exactly once").awaitTermination()
    assert done == [3]


def test_region_deploys_while_it_runs(spark, tmp_path):
    import os

    region = Region()
    at = tmp_path / "up.py"
    at.write_text("from pyspark.sql import functions as F\ndef install(region):\n    region.rule('A', F.upper)\n")
    assert region.deploy(str(tmp_path)) == ["up"] and region.deploy(str(tmp_path)) == []
    df = spark.createDataFrame([("A", "x"), ("B", "y")], "trans_id string, commarea string")
    assert sorted((r.commarea, r.condition) for r in region.dispatch(df).collect()) == [("X", "NORMAL"), ("y", "TRANSIDERR")]
    at.write_text(at.read_text().replace("'A', F.upper", "'B', F.reverse"))
    os.utime(at, (1, 1))
    assert region.deploy(str(tmp_path)) == ["up"]
    assert {r.condition for r in region.dispatch(df).collect()} == {"NORMAL"}
    region.tables["T"] = lambda: spark.createDataFrame([("x", 1)], "commarea string, n int")
    assert [r.condition for r in region.read_table(df, "T", "commarea").orderBy("trans_id").collect()] == ["NORMAL", "NOTFND"]
    assert {r.condition for r in region.read_table(df, "NO", "commarea").collect()} == {"DBNOTFOUND"}


def shown(spark, text, **options):
    return Program(text).run(spark, **options)


def test_program_hooks_and_sequential_status(spark, tmp_path):
    seen = []
    text = _program(
        "01 ST PIC XX.",
        """    OPEN OUTPUT F. MOVE 1 TO K. WRITE R. MOVE 2 TO K. WRITE R. MOVE 3 TO K. WRITE R. READ F AT END DISPLAY 'X' END-READ. DISPLAY ST. CLOSE F.
    OPEN I-O F. READ F. READ F. MOVE 20 TO K. REWRITE R. DISPLAY ST. DELETE F RECORD. DISPLAY ST. CLOSE F.
    OPEN INPUT F. PERFORM 3 TIMES READ F END-READ DISPLAY K END-PERFORM. READ F AT END DISPLAY 'END ' ST END-READ. REWRITE R. DISPLAY ST. CLOSE F.
    OPEN EXTEND F. MOVE 4 TO K. WRITE R. CLOSE F. OPEN INPUT F. PERFORM 4 TIMES READ F END-READ END-PERFORM. DISPLAY K.""",
        "    SELECT F ASSIGN TO F FILE STATUS IS ST.",
        "FD F. 01 R. 05 K PIC 9(3).",
    )
    p = shown(spark, text, paths={"F": f"{tmp_path}/f"}, hooks={"F": {"open": lambda f: seen.append(f.mode), "close": lambda f: seen.append("-")}})
    assert p.display == ["X", "37", "00", "41", "1", "20", "3", "END 10", "37", "4"]
    assert seen == ["OUTPUT", "-", "I-O", "-", "INPUT", "-", "EXTEND", "-", "INPUT"]


def test_keyed_file_with_groups_and_tables(spark, tmp_path):
    text = _program(
        "01 E PIC X VALUE 'N'.",
        """    OPEN OUTPUT F. MOVE 7 TO K. MOVE 'ab' TO A. MOVE 5 TO T(2). WRITE R. MOVE 3 TO K. WRITE R. CLOSE F.
    OPEN EXTEND F. MOVE 9 TO K. WRITE R. MOVE 3 TO K. WRITE R INVALID KEY DISPLAY 'THERE' END-WRITE. CLOSE F.
    OPEN INPUT F. PERFORM UNTIL E = 'Y' READ F NEXT RECORD AT END MOVE 'Y' TO E NOT AT END DISPLAY K A T(2) END-READ END-PERFORM. CLOSE F.""",
        "    SELECT F ASSIGN TO F ORGANIZATION INDEXED RECORD KEY K.",
        "FD F. 01 R. 05 G. 10 A PIC X(2). 10 B PIC 9(2). 05 K PIC 9(3). 05 T PIC 9 OCCURS 3.",
    )
    p = shown(spark, text, paths={"F": f"{tmp_path}/f"})
    lines = [r for x in p.display for r in ([x] if isinstance(x, str) else [y.line for y in x.collect()])]
    assert lines == ["THERE", "3ab5", "7ab5", "9ab5"]


def test_loop_writes_of_keys_that_are_there_are_left_out(spark):
    text = _program(
        "01 E PIC X VALUE 'N'.",
        "    OPEN INPUT I OUTPUT F. PERFORM UNTIL E = 'Y' READ I AT END MOVE 'Y' TO E NOT AT END MOVE IK TO K WRITE R END-READ END-PERFORM. CLOSE I F.",
        "    SELECT I ASSIGN TO I. SELECT F ASSIGN TO F ORGANIZATION INDEXED RECORD KEY K.",
        "FD I. 01 IR. 05 IK PIC 9(3).\nFD F. 01 R. 05 K PIC 9(3).",
    )
    p = shown(spark, text, tables={"I": spark.createDataFrame([(5,), (2,), (5,)], "IK int")}, paths={"F": None})
    assert [int(r.K) for r in p.output(p.files["F"]).collect()] == [2, 5]
    assert any(d.level == "WARNING" and "status 22" in d.text for d in p.diagnostics)


def test_names_that_are_not_one(spark):
    data = "01 A. 05 N PIC 9 VALUE 1. 01 B. 05 N PIC 9 VALUE 2."
    assert shown(spark, _program(data, "    DISPLAY N OF A N IN B.")).display == ["12"]
    with pytest.raises(UnsupportedVerbError, match="more than once"):
        shown(spark, _program(data, "    DISPLAY N."))
    with pytest.raises(UnsupportedVerbError, match="N OF C isn't declared"):
        shown(spark, _program(data, "    DISPLAY N OF C."))


def test_go_to_in_a_loop_runs_on_the_driver(spark):
    text = _program(
        "01 S PIC 9(5) VALUE 0.",
        """    OPEN INPUT I.
NEXT-X.
    READ I AT END GO TO DONE-X END-READ. ADD IK TO S. GO TO NEXT-X.
DONE-X.
    DISPLAY S. STOP RUN.""",
        "    SELECT I ASSIGN TO I.",
        "FD I. 01 IR. 05 IK PIC 9(3).",
    )
    assert shown(spark, text, tables={"I": spark.range(5).toDF("IK")}).display == ["10"]


def test_report_verbs_are_noted(spark):
    p = shown(spark, _program("01 A PIC 9.", "    INITIATE REP. GENERATE LINE-X. TERMINATE REP. DISPLAY A."))
    assert p.display == ["0"] and [d.level for d in p.diagnostics] == ["WARNING"] * 3


def test_command_line(spark, tmp_path, capsys):

    from ledgerframe.cobol.__main__ import main

    (tmp_path / "rec.cpy").write_text("01 A PIC 9(2) VALUE 40.\n")
    (tmp_path / "p.cbl").write_text(_program("COPY REC.", "    ADD 2 TO A. DISPLAY 'A ' A. MOVE 3 TO RETURN-CODE. STOP RUN."))
    assert main(["check", f"{tmp_path}/p.cbl"]) == 0 and main([f"{tmp_path}/p.cbl"]) == 3
    assert capsys.readouterr().out == "A 42\n"
    assert main(["build", f"{tmp_path}/p.cbl"]) == 0
    (tmp_path / "bad.cbl").write_text(_program("01 A PIC 9.", "    FROBNICATE A."))
    assert main(["build", f"{tmp_path}/bad.cbl"]) == 1 and not (tmp_path / "bad.py").exists()
    assert "ERROR" in capsys.readouterr().err
    script = (tmp_path / "p.py").read_text()
    assert "COPY" not in script.upper().replace("COPYBOOK", "")
    (tmp_path / "rec.cpy").unlink()
    scope = {"__name__": "made"}
    exec(compile(script, "p.py", "exec"), scope)
    assert scope["finished"](scope["Program"](scope["SOURCE"]), []) == 3 and capsys.readouterr().out == "A 42\n"
