"""Programs: text, statements, loops as plans and, where order matters, on the driver."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerframe.cobol import Program, UnsupportedVerbError, run
from ledgerframe.cobol.source import expanded, plain, words
from ledgerframe.picture import Field, Layout, picture
from ledgerframe.sources import files

HEAD = "IDENTIFICATION DIVISION.\nPROGRAM-ID. T.\nDATA DIVISION.\nWORKING-STORAGE SECTION.\n"
ORDERS = """IDENTIFICATION DIVISION.
PROGRAM-ID. ORDERS.
ENVIRONMENT DIVISION.
INPUT-OUTPUT SECTION.
FILE-CONTROL.
    SELECT ORDERS ASSIGN TO "orders".
    SELECT BIG ASSIGN TO "big".
DATA DIVISION.
FILE SECTION.
FD ORDERS.
01 ORDER-REC.
   05 O-KEY PIC 9(5).
   05 O-AMOUNT PIC S9(5)V99.
   05 O-KIND PIC X.
      88 URGENT VALUE 'U' 'V'.
FD BIG.
01 BIG-REC.
   05 B-KEY PIC 9(5).
   05 B-NET PIC S9(5)V99.
WORKING-STORAGE SECTION.
01 EOF PIC X VALUE 'N'.
   88 DONE VALUE 'Y'.
01 TOTALS.
   05 N PIC 9(7) VALUE 0.
   05 TOTAL PIC S9(9)V99 VALUE 0.
   05 RUSH PIC 9(7) VALUE 0.
   05 TOP PIC S9(5)V99 VALUE 0.
01 NET PIC S9(5)V99.
01 LAST-KEY PIC 9(5).
01 SHOWN PIC ZZZ,ZZ9.99.
PROCEDURE DIVISION.
MAIN-PARA.
    OPEN INPUT ORDERS OUTPUT BIG.
"""
LOOPS = {
    "reads first": """    PERFORM UNTIL DONE
      READ ORDERS AT END MOVE 'Y' TO EOF NOT AT END PERFORM ONE END-READ
    END-PERFORM.""",
    "reads ahead": """    READ ORDERS AT END SET DONE TO TRUE END-READ.
    PERFORM UNTIL DONE
      PERFORM ONE
      READ ORDERS AT END SET DONE TO TRUE END-READ
    END-PERFORM.""",
    "tests the end": """    PERFORM UNTIL EOF = 'Y'
      READ ORDERS AT END MOVE 'Y' TO EOF END-READ
      IF NOT DONE PERFORM ONE END-IF
    END-PERFORM.""",
}
TAIL = """
    MOVE TOTAL TO SHOWN. DISPLAY 'TOTAL ' SHOWN ' OF ' N.
    CLOSE ORDERS BIG. STOP RUN.
ONE.
    ADD 1 TO N. ADD O-AMOUNT TO TOTAL.
    COMPUTE NET ROUNDED = O-AMOUNT * 0.9.
    MOVE O-KEY TO LAST-KEY.
    IF O-AMOUNT > TOP MOVE O-AMOUNT TO TOP END-IF
    EVALUATE TRUE
      WHEN URGENT ADD 1 TO RUSH
      WHEN OTHER CONTINUE
    END-EVALUATE.
    IF NET > 50 MOVE O-KEY TO B-KEY MOVE NET TO B-NET WRITE BIG-REC END-IF.
"""


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cobol")
    layout = Layout.of("R", Field("K", picture("9(5)")), Field("A", picture("S9(5)V99")), Field("T", picture("X")))
    df = spark.range(100).selectExpr("cast(id as decimal(5,0)) K", "cast((id * 37 % 101) + 0.25 as decimal(7,2)) A", "case when id % 3 = 0 then 'U' when id % 7 = 0 then 'V' else 'N' end T")
    files.write_fixed(df.repartitionByRange(3, "K").sortWithinPartitions("K"), f"{d}/orders", layout)
    return d


@pytest.mark.parametrize("loop", LOOPS)
def test_loop_is_a_plan(spark, orders, tmp_path, loop):
    p = run(ORDERS + LOOPS[loop] + TAIL, spark, paths={"orders": f"{orders}/orders", "big": f"{tmp_path}/big"})
    amounts = [Decimal(i * 37 % 101) + Decimal("0.25") for i in range(100)]
    assert [(d.level, "one plan" in d.text) for d in p.diagnostics] == [("INFO", True)]
    get = lambda n: p.get(("ref", n, [], None)).value
    assert (get("N"), get("TOTAL"), get("TOP"), get("LAST_KEY")) == (100, sum(amounts), max(amounts), 99)
    assert get("RUSH") == sum(i % 3 == 0 or i % 7 == 0 for i in range(100))
    assert p.display == [f"TOTAL {sum(amounts):>10,} OF 100"]
    net = [(Decimal(i), (a * Decimal("0.9")).quantize(Decimal("0.01"), "ROUND_HALF_UP")) for i, a in enumerate(amounts)]
    got = files.read_relative(spark, f"{tmp_path}/big", Layout.of("B", Field("K", picture("9(5)")), Field("V", picture("S9(5)V99")))).orderBy("rrn")
    assert [(r.K, r.V) for r in got.collect()] == [x for x in net if x[1] > 50]


def test_loop_over_previous_records_is_a_plan(spark, orders, tmp_path):
    body = "ONE.\n    IF O-AMOUNT > NET ADD 1 TO N MOVE O-KEY TO B-KEY MOVE NET TO B-NET WRITE BIG-REC END-IF. MOVE O-AMOUNT TO NET.\n"
    amounts = [Decimal(i * 37 % 101) + Decimal("0.25") for i in range(100)]
    up = [(Decimal(i), b) for i, (a, b) in enumerate(zip(amounts, [Decimal(0), *amounts])) if a > b]
    layout = Layout.of("R", Field("K", picture("9(5)")), Field("A", picture("S9(5)V99")), Field("T", picture("X")))
    text = ORDERS + LOOPS["reads first"] + "\n    CLOSE ORDERS BIG. STOP RUN.\n" + body
    table = files.read_relative(spark, f"{orders}/orders", layout).orderBy("rrn").toDF("rrn", "O_KEY", "O_AMOUNT", "O_KIND").drop("rrn")
    for how in ({"paths": {"orders": f"{orders}/orders", "big": None}}, {"paths": {"big": None}, "tables": {"ORDERS": table}}):
        p = run(text, spark, **how)
        assert [d.level for d in p.diagnostics] == ["INFO"]
        assert p.get(("ref", "N", [], None)).value == len(up) and p.get(("ref", "NET", [], None)).value == amounts[-1]
        assert sorted(map(tuple, p.output(p.files["BIG"]).collect())) == up


def test_order_dependent_loop_runs_on_driver(spark, orders, tmp_path):
    body = "ONE.\n    IF O-AMOUNT > NET ADD 1 TO N MOVE O-AMOUNT TO NET END-IF.\n"
    p = run(ORDERS + LOOPS["reads first"] + "\n    CLOSE ORDERS BIG. STOP RUN.\n" + body, spark, paths={"orders": f"{orders}/orders", "big": f"{tmp_path}/b"})
    amounts, most, n = [i * 37 % 101 + 0.25 for i in range(100)], 0, 0
    for a in amounts:
        n, most = (n + 1, a) if a > most else (n, most)
    assert p.diagnostics[0].level == "WARNING"
    assert p.env["N"].value == n


def test_sum_beyond_its_field_keeps_the_rule_of_size_errors(spark, orders, tmp_path):
    text = ORDERS.replace("TOTAL PIC S9(9)V99", "TOTAL PIC S9(2)V99") + LOOPS["reads first"] + TAIL
    p = run(text, spark, paths={"orders": f"{orders}/orders", "big": f"{tmp_path}/b"})
    want = Decimal(0)
    for i in range(100):
        x = want + i * 37 % 101 + Decimal("0.25")
        want = x if x < 100 else want
    assert p.diagnostics[0].level == "WARNING" and p.env["TOTAL"].value == want


def program(spark, data, body, **options):
    return run(HEAD + data + "PROCEDURE DIVISION.\nMAIN-PARA.\n" + body, spark, **options)


def test_arithmetic_and_control(spark):
    data = "01 A PIC S9(3)V99 VALUE 10.50.\n01 B PIC 9(3).\n01 C PIC S9(3)V99.\n01 R PIC S9(3).\n01 I PIC 9(2).\n01 J PIC 9(2).\n01 S PIC X(5) VALUE 'ab'.\n01 T PIC X(12).\n01 E PIC X VALUE 'N'.\n"
    p = program(spark, data, """    ADD 1 2 TO B. ADD A B GIVING C. SUBTRACT 0.5 FROM C.
    DIVIDE 17 BY 5 GIVING B REMAINDER R.
    MULTIPLY 2 BY A. COMPUTE C ROUNDED = A / 8 + 2 ** 3 - (1 - 3).
    DISPLAY A ' ' B ' ' C ' ' R.
    MOVE 0 TO B. PERFORM VARYING I FROM 1 BY 1 UNTIL I > 3 AFTER J FROM 1 BY 1 UNTIL J > 2 ADD J TO B END-PERFORM.
    PERFORM ADDS 4 TIMES. PERFORM ADDS THRU ADDS-2. DISPLAY B.
    ADD 990 TO B ON SIZE ERROR MOVE 'Y' TO E NOT ON SIZE ERROR MOVE 'Z' TO E END-ADD.
    DIVIDE 0 INTO A ON SIZE ERROR DISPLAY 'ZERO' END-DIVIDE.
    STRING S DELIMITED BY SPACE '-' S(2:1) DELIMITED BY SIZE INTO T. DISPLAY T E.
    INSPECT T REPLACING ALL 'a' BY 'x'. MOVE 0 TO I. INSPECT T TALLYING I FOR ALL 'b'. DISPLAY T I.
    IF A > 20 AND < 30 AND (E = 'N' OR 'Y') DISPLAY 'IN' ELSE DISPLAY 'OUT'.
    EVALUATE B ALSO E WHEN 1 THRU 20 ALSO 'Y' DISPLAY 'ALSO' WHEN OTHER DISPLAY 'NO' END-EVALUATE.
    DISPLAY FUNCTION UPPER-CASE(S) FUNCTION LENGTH(T). STOP RUN.
ADDS.
    ADD 1 TO B.
ADDS-2.
    ADD 2 TO B.
""")
    assert p.display == ["21.00 3 12.63 2", "16", "ZERO", "ab-b        Y", "xb-b        2", "IN", "ALSO", "AB   12"]


def test_tables_search_redefines_unstring(spark):
    data = """01 T.
   05 ITEM OCCURS 3.
      10 CODE-X PIC X(3).
      10 PRICE PIC 9(3)V99.
01 IX PIC 9(2).
01 D PIC X(8) VALUE '20260501'.
01 DP REDEFINES D.
   05 Y PIC 9(4).
   05 M PIC 9(2).
01 L PIC X(20) VALUE 'one,two;three'.
01 P1 PIC X(5).
01 P2 PIC X(5).
01 P3 PIC X(5).
01 G1. 05 NAME PIC X(4) VALUE 'AB'. 05 AGE PIC 9(2) VALUE 7.
"""
    p = program(spark, data, """    MOVE 'AAA' TO CODE-X(1). MOVE 'BBB' TO CODE-X(2). MOVE 2.5 TO PRICE(2).
    MOVE 1 TO IX. SEARCH ITEM AT END DISPLAY 'NONE' WHEN CODE-X(IX) = 'BBB' DISPLAY 'FOUND ' IX ' ' PRICE(IX) END-SEARCH.
    SEARCH ALL ITEM AT END DISPLAY 'NONE' WHEN CODE-X(IX) = 'ZZZ' CONTINUE END-SEARCH.
    MOVE 12 TO M. DISPLAY Y ' ' D. UNSTRING L DELIMITED BY ',' OR ';' INTO P1 P2 P3. DISPLAY P1 P2 P3.
    DISPLAY G1. MOVE 'XYZW42' TO G1. DISPLAY NAME AGE. INITIALIZE G1. DISPLAY G1 '.'. MOVE ALL '*' TO P1. DISPLAY P1.
""")
    assert p.display == ["FOUND 2 2.50", "NONE", "2026 20261201", "one  two  three", "AB  07", "XYZW42", "    00.", "*****"]


def test_sql_cursor_is_a_plan(spark):
    spark.createDataFrame([(i, Decimal(i) * 2, i % 2 == 0) for i in range(20)], "k int, v decimal(9,2), even boolean").createOrReplaceTempView("t_cobol")
    text = """    EXEC SQL DECLARE C CURSOR FOR SELECT k, v FROM t_cobol WHERE k >= :LOW END-EXEC.
    MOVE 5 TO LOW. EXEC SQL OPEN C END-EXEC.
    PERFORM UNTIL SQLCODE = 100
      EXEC SQL FETCH C INTO :K, :V END-EXEC
      IF SQLCODE = 0 ADD V TO S ADD 1 TO N END-IF
    END-PERFORM.
    EXEC SQL SELECT count(*) INTO :CNT FROM t_cobol WHERE k < :LOW END-EXEC.
    EXEC SQL UPDATE t_cobol SET v = v + 1 WHERE k = :LOW END-EXEC. EXEC SQL COMMIT END-EXEC.
    DISPLAY N ' ' S ' ' CNT ' ' SQLCODE.
"""
    p = program(spark, "01 K PIC 9(4).\n01 V PIC S9(7)V99.\n01 S PIC S9(7)V99.\n01 N PIC 9(4).\n01 LOW PIC 9(4).\n01 CNT PIC 9(4).\n", text)
    assert p.display == [f"15 {sum(range(5, 20)) * 2}.00 5 0"] and p.diagnostics[0].level == "INFO"
    assert spark.table("t_cobol").where("k = 5").first().v == 11


def test_sort_procedures_and_keyed_read(spark, tmp_path):
    text = """IDENTIFICATION DIVISION.
PROGRAM-ID. S.
ENVIRONMENT DIVISION. INPUT-OUTPUT SECTION. FILE-CONTROL.
    SELECT F ASSIGN TO F. SELECT W ASSIGN TO W.
    SELECT X ASSIGN TO X ORGANIZATION IS INDEXED RECORD KEY IS X-KEY.
    SELECT O ASSIGN TO O.
DATA DIVISION. FILE SECTION.
FD F. 01 F-REC. 05 F-KEY PIC 9(3). 05 F-V PIC 9(3).
SD W. 01 W-REC. 05 W-KEY PIC 9(3). 05 W-V PIC 9(3).
FD X. 01 X-REC. 05 X-KEY PIC 9(3). 05 X-NAME PIC X(4).
FD O. 01 O-REC. 05 O-V PIC 9(3). 05 O-NAME PIC X(4).
WORKING-STORAGE SECTION.
01 E PIC X VALUE 'N'. 01 E2 PIC X VALUE 'N'.
PROCEDURE DIVISION.
MAIN-PARA.
    OPEN INPUT F X OUTPUT O.
    SORT W ON DESCENDING KEY W-V INPUT PROCEDURE IS PUT OUTPUT PROCEDURE IS GET.
    CLOSE F X O. STOP RUN.
PUT.
    PERFORM UNTIL E = 'Y'
      READ F AT END MOVE 'Y' TO E
        NOT AT END IF F-V > 10 MOVE F-KEY TO W-KEY MOVE F-V TO W-V RELEASE W-REC END-IF END-READ
    END-PERFORM.
GET.
    PERFORM UNTIL E2 = 'Y'
      RETURN W AT END MOVE 'Y' TO E2 NOT AT END
        MOVE W-KEY TO X-KEY
        READ X KEY IS X-KEY INVALID KEY MOVE '????' TO O-NAME NOT INVALID KEY MOVE X-NAME TO O-NAME END-READ
        MOVE W-V TO O-V WRITE O-REC
      END-RETURN
    END-PERFORM.
"""
    f = spark.createDataFrame([(1, 5), (2, 30), (3, 20), (4, 40)], "F_KEY int, F_V int")
    x = spark.createDataFrame([(2, "two"), (4, "four")], "X_KEY int, X_NAME string")
    p = run(text, spark, tables={"F": f, "X": x}, paths={"O": f"{tmp_path}/o"})
    assert {d.level for d in p.diagnostics} == {"INFO"}
    out = Layout.of("O", Field("V", picture("9(3)")), Field("N", picture("X(4)")))
    got = files.read_fixed(spark, f"{tmp_path}/o", out)
    assert sorted((int(r.V), r.N) for r in got.collect()) == [(20, "????"), (30, "two "), (40, "four")]


def test_call_by_reference_and_content(spark):
    sub = Program("IDENTIFICATION DIVISION.\nPROGRAM-ID. SUB.\nDATA DIVISION.\nLINKAGE SECTION.\n01 A PIC 9(3).\n01 B PIC 9(3).\nPROCEDURE DIVISION USING A B.\nP1.\n    ADD 1 TO A. ADD 1 TO B. GOBACK.\n")
    p = program(spark, "01 A PIC 9(3) VALUE 5.\n01 B PIC 9(3) VALUE 5.\n", "    CALL 'SUB' USING A BY CONTENT B. CALL 'NO' ON EXCEPTION DISPLAY 'NONE' END-CALL. DISPLAY A B.\n", programs={"SUB": sub})
    assert p.display == ["NONE", "65"]


def test_keyed_verbs_status_and_text(spark, tmp_path):
    head = """IDENTIFICATION DIVISION.
PROGRAM-ID. K.
ENVIRONMENT DIVISION. INPUT-OUTPUT SECTION. FILE-CONTROL.
    SELECT X ASSIGN TO X ORGANIZATION IS INDEXED RECORD KEY IS X-KEY FILE STATUS IS ST.
    SELECT M ASSIGN TO M FILE STATUS IS ST.
DATA DIVISION. FILE SECTION.
FD X. 01 X-REC. 05 X-KEY PIC 9(3). 05 X-NAME PIC X(4).
FD M. 01 M-REC. 05 M-KEY PIC 9(3).
WORKING-STORAGE SECTION.
01 ST PIC XX. 01 J PIC X(60).
01 G. 05 N PIC S9(3)V99 VALUE 1.5. 05 T PIC X(6) VALUE 'a "b'.
PROCEDURE DIVISION.
MAIN-PARA.
    OPEN INPUT M. DISPLAY ST. OPEN I-O X. DISPLAY ST.
    MOVE 2 TO X-KEY. START X KEY IS GREATER THAN X-KEY INVALID KEY DISPLAY 'NONE' END-START.
    READ X NEXT RECORD AT END DISPLAY 'END' END-READ. DISPLAY X-KEY X-NAME.
    DELETE X RECORD. DISPLAY ST. DELETE X RECORD INVALID KEY DISPLAY 'GONE ' ST END-DELETE.
    MOVE 99 TO X-KEY. START X KEY IS >= X-KEY INVALID KEY DISPLAY 'NONE ' ST END-START.
    JSON GENERATE J FROM G. DISPLAY J. INITIALIZE G. JSON PARSE J INTO G. DISPLAY N T '.'.
    XML GENERATE J FROM G END-XML. INITIALIZE G. XML PARSE J INTO G. DISPLAY N T '.'. CANCEL 'SUB'.
"""
    x = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four"), (9, "nine")], "X_KEY int, X_NAME string")
    p = run(head, spark, tables={"X": x}, paths={"M": f"{tmp_path}/none"})
    json = '{"N":1.50,"T":"a \\"b"}'
    assert p.display == ["35", "00", "4four", "00", "GONE 23", "NONE 23", json.ljust(60), '1.50a "b  .', '1.50a "b  .']


@pytest.mark.parametrize("body", ["    GO TO X.\n", "    ALTER X TO PROCEED TO Y.\n", "    MOVE NOPE TO A.\n", "    FROBNICATE A.\n", "    PERFORM NOWHERE.\n"])
def test_unsupported(spark, body):
    with pytest.raises(UnsupportedVerbError):
        program(spark, "01 A PIC 9.\n", body)


def test_source(tmp_path):
    (tmp_path / "rec.cpy").write_text("       01 :TAG:-REC.\n          05 OLD-NAME PIC X(3).\n")
    got = expanded("COPY REC REPLACING ==:TAG:== BY ==IN== OLD-NAME BY NEW-NAME.\nX", [str(tmp_path)])
    assert got.split() == "01 IN-REC. 05 NEW-NAME PIC X(3). X".split()
    fixed = "000100 IDENTIFICATION DIVISION.\n000200* a comment\n000300     DISPLAY 'ab\n000400-    'cd'.\n"
    assert plain(fixed).split("\n")[0] == "IDENTIFICATION DIVISION." and "comment" not in plain(fixed)
    assert words("MOVE 'it''s' TO A-B(1:2). COMPUTE C = A -1")[1] == ("text", "it's")
    assert words("COMPUTE C = A -1")[-2:] == [("op", "-"), ("number", "1")]


def test_call_in_a_loop_is_a_plan(spark):
    sub = Program("""IDENTIFICATION DIVISION.
PROGRAM-ID. FEE.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 BASE PIC S9(5)V99 VALUE 2.50.
LINKAGE SECTION.
01 AMOUNT PIC S9(5)V99.
01 KIND PIC X.
01 FEE PIC S9(5)V99.
PROCEDURE DIVISION USING AMOUNT KIND FEE.
MAIN-X.
    PERFORM RATE-X. IF KIND = 'U' ADD BASE TO FEE END-IF. IF FEE > 50 MOVE 50 TO FEE END-IF. GOBACK.
RATE-X.
    COMPUTE FEE ROUNDED = AMOUNT * 0.1.
""")
    text = ORDERS + LOOPS["reads first"] + "\n    CLOSE ORDERS BIG. STOP RUN.\nONE.\n    CALL 'FEE' USING O-AMOUNT O-KIND NET. ADD NET TO TOTAL. MOVE O-KEY TO B-KEY. MOVE NET TO B-NET. WRITE BIG-REC.\n"
    x = spark.range(200).selectExpr("id O_KEY", "cast(id * 5 + 0.25 as decimal(7,2)) O_AMOUNT", "if(id % 2 = 0, 'U', 'N') O_KIND")
    p = run(text, spark, tables={"ORDERS": x}, paths={"big": None}, programs={"FEE": sub})
    assert [d.level for d in p.diagnostics] == ["INFO"]
    want = []
    for i in range(200):
        fee = (Decimal(i * 5) + Decimal("0.25")) * Decimal("0.1")
        want.append((i, min(fee.quantize(Decimal("0.01"), "ROUND_HALF_UP") + (Decimal("2.50") if i % 2 == 0 else 0), Decimal(50))))
    assert sorted((int(a), b) for a, b in p.output(p.files["BIG"]).collect()) == want and p.get(("ref", "TOTAL", [], None)).value == sum(f for _, f in want)
    said = Program(sub.text.replace("PERFORM RATE-X.", "DISPLAY KIND. PERFORM RATE-X."))
    p = run(text, spark, tables={"ORDERS": x.limit(3)}, paths={"big": None}, programs={"FEE": said})
    assert p.diagnostics[0].level == "WARNING" and len(p.display) == 3  # what it displays is one thing after the other
