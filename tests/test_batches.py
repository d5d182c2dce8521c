"""Whole batch jobs with known results: payroll, an account report, an order desk, shipment intake, query and report."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerframe.cobol import Program
from ledgerframe.functions import numeric
from ledgerframe.operators import records
from ledgerframe.picture import PACKED, Field, Layout, picture
from ledgerframe.plans.verbs import _program
from ledgerframe.sources import files

SHIPMENTS = [
    ("SA", "ACME WIDGETS", "STEEL BOLTS 1/4 IN", 100, "12.50", "2026-04-01"), ("SA", "ACME WIDGETS", "HEX NUTS 3/8 IN", 150, "8.75", "2026-04-03"), ("SA", "ACME WIDGETS", "FLAT WASHERS", 100, "5.25", "2026-04-05"),
    ("SB", "BAKER SUPPLY", "COPPER WIRE 12GA", 200, "15.00", "2026-04-02"), ("SB", "BAKER SUPPLY", "SOLDER PASTE", 50, "22.50", "2026-04-04"), ("SB", "BAKER SUPPLY", "HEAT SHRINK TUBE", 150, "6.75", "2026-04-06"), ("SB", "BAKER SUPPLY", "WIRE CONNECTORS", 100, "9.80", "2026-04-08"),
    ("SC", "CARTER LOGISTICS", "CARDBOARD BOXES LG", 75, "18.50", "2026-04-01"), ("SC", "CARTER LOGISTICS", "PACKING TAPE", 100, "4.25", "2026-04-03"), ("SC", "CARTER LOGISTICS", "BUBBLE WRAP ROLL", 100, "12.75", "2026-04-07"),
    ("SD", "DELTA MATERIALS", "PVC PIPE 2IN", 150, "14.50", "2026-04-02"), ("SD", "DELTA MATERIALS", "PIPE FITTINGS", 100, "8.25", "2026-04-05"), ("SD", "DELTA MATERIALS", "VALVE ASSEMBLY", 150, "22.00", "2026-04-09"),
]
SUMMARY = {"SA": (3, 350, "3087.50", "2026-04-05"), "SB": (4, 500, "6117.50", "2026-04-08"), "SC": (3, 275, "3087.50", "2026-04-07"), "SD": (3, 400, "6300.00", "2026-04-09")}


@pytest.fixture(scope="module")
def shipments(spark):
    rows = [(a, b, c, Decimal(n), Decimal(p), d) for a, b, c, n, p, d in SHIPMENTS]
    df = spark.createDataFrame(rows, "supplier string, name string, item string, qty decimal(5,0), price decimal(7,2), ship_date string")
    df.createOrReplaceTempView("shipments")
    return df


def test_payroll(spark):
    body = """    OPEN INPUT STAFF.
    PERFORM UNTIL E = 'Y'
      READ STAFF AT END MOVE 'Y' TO E NOT AT END PERFORM PAY-ONE END-READ
    END-PERFORM.
    CLOSE STAFF. MOVE ALL-GROSS TO SHOWN. DISPLAY 'GROSS ' SHOWN. MOVE ALL-TAX TO SHOWN. DISPLAY 'TAX ' SHOWN. MOVE ALL-NET TO SHOWN. DISPLAY 'NET ' SHOWN. STOP RUN.
PAY-ONE.
    COMPUTE GROSS = HOURS * RATE.
    IF HOURS > 40 COMPUTE EXTRA = (HOURS - 40) * RATE * 0.5 ADD EXTRA TO GROSS END-IF.
    COMPUTE TAX ROUNDED = GROSS * TAX-RATE. SUBTRACT TAX FROM GROSS GIVING NET.
    ADD GROSS TO ALL-GROSS. ADD TAX TO ALL-TAX. ADD NET TO ALL-NET."""
    data = """01 E PIC X VALUE 'N'. 01 GROSS PIC S9(7)V99. 01 TAX PIC S9(7)V99. 01 NET PIC S9(7)V99. 01 EXTRA PIC S9(5)V99. 01 TAX-RATE PIC S9V9999 VALUE 0.22.
01 ALL-GROSS PIC S9(9)V99 VALUE 0. 01 ALL-TAX PIC S9(9)V99 VALUE 0. 01 ALL-NET PIC S9(9)V99 VALUE 0. 01 SHOWN PIC Z(5)9.99."""
    text = _program(data, body, "    SELECT STAFF ASSIGN TO S.", "FD STAFF. 01 S-REC. 05 NAME PIC X(20). 05 HOURS PIC 9(3). 05 RATE PIC S9(3)V99.")
    staff = spark.createDataFrame([("A", 40, Decimal("25.00"))] * 3, "NAME string, HOURS int, RATE decimal(5,2)")
    p = Program(text).run(spark, tables={"STAFF": staff})
    assert [s.split() for s in p.display] == [["GROSS", "3000.00"], ["TAX", "660.00"], ["NET", "2340.00"]]
    assert [d.level for d in p.diagnostics] == ["INFO"]


def test_account_report(spark, tmp_path):
    layout = Layout.of("A", Field("ACCT", picture("X(8)")), Field("LIM", picture("S9(7)V99"), PACKED), Field("BAL", picture("S9(7)V99"), PACKED), Field("LAST_NAME", picture("X(20)")))
    rows = [("10101010", "15000.00", "14500.00", "ROGERS"), ("10201020", "8000.00", "6500.50", "NELSON"), ("10301030", "25000.00", "22000.75", "FRANKLIN"), ("10401040", "5000.00", "4800.00", "LINCOLN"), ("10501050", "12000.00", "11250.25", "JEFFERSON")]
    files.write_fixed(spark.createDataFrame([(a, Decimal(x), Decimal(y), n) for a, x, y, n in rows], layout.struct()).coalesce(1), f"{tmp_path}/in", layout)
    body = """    OPEN INPUT ACCTS OUTPUT REPORT-F.
    PERFORM UNTIL E = 'Y'
      READ ACCTS AT END MOVE 'Y' TO E NOT AT END
        ADD LIM TO ALL-LIM ADD BAL TO ALL-BAL MOVE ACCT TO R-ACCT MOVE LIM TO R-LIM MOVE BAL TO R-BAL
        MOVE FUNCTION LOWER-CASE(LAST-NAME) TO R-NAME MOVE LAST-NAME(1:1) TO R-NAME(1:1) WRITE R-REC
      END-READ
    END-PERFORM.
    CLOSE ACCTS REPORT-F. DISPLAY ALL-LIM ' ' ALL-BAL. STOP RUN."""
    records_ = """FD ACCTS. 01 A-REC. 05 ACCT PIC X(8). 05 LIM PIC S9(7)V99 COMP-3. 05 BAL PIC S9(7)V99 COMP-3. 05 LAST-NAME PIC X(20).
FD REPORT-F. 01 R-REC. 05 R-ACCT PIC X(8). 05 FILLER PIC X(2). 05 R-NAME PIC X(20). 05 FILLER PIC X(2). 05 R-LIM PIC $$,$$$,$$9.99. 05 FILLER PIC X(2). 05 R-BAL PIC $$,$$$,$$9.99."""
    text = _program("01 E PIC X VALUE 'N'. 01 ALL-LIM PIC S9(9)V99 VALUE 0. 01 ALL-BAL PIC S9(9)V99 VALUE 0.", body, "    SELECT ACCTS ASSIGN TO A. SELECT REPORT-F ASSIGN TO R.", records_)
    p = Program(text).run(spark, paths={"A": f"{tmp_path}/in", "R": f"{tmp_path}/out"})
    got = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").iterdir()) if f.name.startswith("part")).decode()
    size = 8 + 2 + 20 + 2 + 13 + 2 + 13
    shown = [got[i : i + size] for i in range(0, len(got), size)]
    want = [f"{a}  {n.capitalize():<20}  {'$' + format(Decimal(x), ',.2f'):>13}  {'$' + format(Decimal(y), ',.2f'):>13}" for a, x, y, n in rows]
    assert shown == want and p.display == ["65000.00 59051.50"]


def test_order_desk(spark):
    data = """01 TODAY-X PIC X(8) VALUE '20260501'. 01 PARTS REDEFINES TODAY-X. 05 YY PIC X(4). 05 MM PIC X(2). 05 DD PIC X(2).
01 TAB. 05 ITEM OCCURS 5. 10 CODE-X PIC X(10). 10 PRICE PIC S9(5)V99. 10 QTY PIC 9(5).
01 IX PIC 9(2). 01 FOUND-X PIC X VALUE 'N'. 01 ITEMS PIC 9(7) VALUE 0. 01 ORDERS PIC 9(5) VALUE 1. 01 TOTAL PIC S9(9)V99 VALUE 5000. 01 TAX PIC S9(7)V99. 01 GRAND PIC S9(9)V99. 01 AVERAGE PIC S9(7)V99. 01 SHOWN PIC Z(7)9.99.
01 KIND PIC X VALUE 'Q'. 88 PREMIUM VALUE 'P' THRU 'Z'."""
    rows = [("WIDGET-A", "29.99", 100), ("GADGET-B", "49.99", 50), ("DEVICE-C", "99.99", 25), ("TOOL-D", "19.99", 200), ("PART-E", "9.99", 550)]
    fill = "".join(f"    MOVE '{c}' TO CODE-X({i}). MOVE {p} TO PRICE({i}). MOVE {q} TO QTY({i}).\n" for i, (c, p, q) in enumerate(rows, 1))
    body = fill + """    PERFORM VARYING IX FROM 1 BY 1 UNTIL IX > 5 ADD QTY(IX) TO ITEMS END-PERFORM.
    MOVE 1 TO IX. SEARCH ITEM AT END MOVE 'N' TO FOUND-X WHEN CODE-X(IX) = 'DEVICE-C' MOVE 'Y' TO FOUND-X END-SEARCH.
    COMPUTE TAX = TOTAL * 0.08. ADD TOTAL TAX GIVING GRAND. DIVIDE TOTAL BY ORDERS GIVING AVERAGE.
    MOVE TAX TO SHOWN. DISPLAY 'TAX ' SHOWN. MOVE GRAND TO SHOWN. DISPLAY 'GRAND ' SHOWN. MOVE AVERAGE TO SHOWN. DISPLAY 'AVERAGE ' SHOWN.
    DISPLAY 'ITEMS ' ITEMS ' FOUND ' FOUND-X ' ' IX ' DATE ' YY '/' MM '/' DD. IF PREMIUM DISPLAY 'PREMIUM' END-IF. STOP RUN."""
    p = Program(_program(data, body)).run(spark)
    assert [" ".join(s.split()) for s in p.display] == ["TAX 400.00", "GRAND 5400.00", "AVERAGE 5000.00", "ITEMS 925 FOUND Y 3 DATE 2026/05/01", "PREMIUM"]


QUERY = _program(
    "01 S-NAME PIC X(20). 01 QTY PIC 9(5). 01 PRICE PIC S9(5)V99. 01 SHIP-DATE PIC X(10). 01 VAL PIC S9(9)V99. 01 WANTED PIC X(4) VALUE 'SB'.\n01 N PIC 9(5) VALUE 0. 01 ALL-QTY PIC 9(7) VALUE 0. 01 ALL-VAL PIC S9(9)V99 VALUE 0. 01 LATEST PIC X(10) VALUE SPACES.",
    """    EXEC SQL DECLARE C CURSOR FOR SELECT name, qty, price, ship_date FROM shipments WHERE supplier = :WANTED END-EXEC.
    EXEC SQL OPEN C END-EXEC.
    PERFORM UNTIL SQLCODE = 100
      EXEC SQL FETCH C INTO :S-NAME, :QTY, :PRICE, :SHIP-DATE END-EXEC
      IF SQLCODE = 0
        COMPUTE VAL = QTY * PRICE
        ADD 1 TO N ADD QTY TO ALL-QTY ADD VAL TO ALL-VAL
        IF SHIP-DATE > LATEST MOVE SHIP-DATE TO LATEST END-IF
      END-IF
    END-PERFORM.
    EXEC SQL CLOSE C END-EXEC. DISPLAY WANTED N ' ' ALL-QTY ' ' ALL-VAL ' ' LATEST.""",
)


@pytest.mark.parametrize("supplier", SUMMARY)
def test_shipment_query(spark, shipments, supplier):
    p = Program(QUERY.replace("'SB'", f"'{supplier}'")).run(spark)
    n, qty, value, latest = SUMMARY[supplier]
    assert p.display == [f"{supplier}  {n} {qty} {value} {latest}"] and [d.level for d in p.diagnostics] == ["INFO"]


def test_shipment_intake(spark, shipments):
    shipments.limit(0).createOrReplaceTempView("stored")
    data = """01 S-ID PIC X(4). 01 QTY PIC 9(5). 01 PRICE PIC S9(5)V99. 01 ST PIC XX. 88 OK-X VALUE '00'. 88 INVALID-X VALUE '10'."""
    take = """    IF S-ID = SPACES OR QTY = 0 OR PRICE NOT > 0 MOVE '10' TO ST ELSE
      EXEC SQL INSERT INTO stored (supplier, qty, price) VALUES (:S-ID, :QTY, :PRICE) END-EXEC MOVE '00' TO ST END-IF.
    DISPLAY ST."""
    body = "".join(f"    MOVE {s} TO S-ID. MOVE {q} TO QTY. MOVE {p} TO PRICE. PERFORM TAKE-X.\n" for s, q, p in (("'SA'", 5, 2.5), ("SPACES", 5, 2.5), ("'SB'", 0, 2.5), ("'SB'", 7, 0), ("'SD'", 7, 1)))
    p = Program(_program(data, body + "    EXEC SQL COMMIT END-EXEC. STOP RUN.\nTAKE-X.\n" + take)).run(spark)
    assert p.display == ["00", "10", "10", "10", "00"]
    assert sorted((r.supplier, int(r.qty), r.price) for r in spark.table("stored").collect()) == [("SA", 5, Decimal("2.50")), ("SD", 7, Decimal("1.00"))]
    good, bad = records.split(shipments, (F.trim("supplier") != "") & (F.col("qty") > 100) & (F.col("price") > 0))
    assert good.count() + bad.count() == len(SHIPMENTS) and bad.where("qty > 100").count() == 0


def test_shipment_report(spark, shipments):
    """Suppliers in the order in which notices name them, a query for each as one plan, and the grand total."""
    notices = spark.createDataFrame([(i, s) for i, s in enumerate(["SC", "SA", "SC", "SD", "SB", "SA"])], "seq int, supplier string")

    def query(keys):
        value = numeric.stored(F.col("qty") * F.col("price"), "S9(9)V99")
        by = shipments.join(keys, "supplier").withColumn("value", value).groupBy("supplier")
        return by.agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum("value").alias("value"), F.max("ship_date").alias("latest"))

    report = records.call_by_key(records.first_seen(notices, "supplier", "seq"), "supplier", query).orderBy("seq")
    got = [(r.supplier, r.n, int(r.qty), str(r.value), r.latest) for r in report.collect()]
    assert got == [(s, *SUMMARY[s]) for s in ("SC", "SA", "SD", "SB")]
    total = records.control_break(report, ["supplier"], n=F.sum("n"), qty=F.sum("qty"), value=F.sum("value")).where("break_level = 0").first()
    assert (total.n, int(total.qty), str(total.value)) == (13, 1525, "18592.50")
