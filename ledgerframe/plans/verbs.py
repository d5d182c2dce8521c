"""Queries over string verbs, intrinsic functions, embedded SQL, programs' statements, ports, regions, queues and windows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cobol import Program
from ..functions import intrinsics, strings
from ..picture import Layout
from ..sources import folders
from ..sql import Session
from ..streaming import windows
from ..streaming.ports import Port, Queues, Region, listen, response
from .catalog import money, query, read
from .records import place

COPYBOOKS = os.path.join(os.path.dirname(__file__), "copybooks")


@query("select c_custkey, rpad('ab' || c_mktsegment || '-' || substr(c_name, 10), 20, '.') as target, cast(least(length(c_mktsegment) + 4 + 9, 21) as integer) as next_at, length(c_mktsegment) + 3 + 9 > 20 as overflow from customer")
def string_pointer(spark: SparkSession, d: str) -> DataFrame:
    """STRING WITH POINTER 3: what stands before the pointer and behind what is written stays."""
    out, at, over = strings.string(F.lit("ab" + "." * 18), 20, (F.col("c_mktsegment"), None), (F.lit("-"), None), (F.expr("substr(c_name, 10)"), None), pointer=3)
    return read(spark, d, "customer").select("c_custkey", out.alias("target"), at.alias("next_at"), over.alias("overflow"))


SQL_UNSTRING = """select p_partkey, split_part(t, ',', 1) a, split_part(split_part(t, ',', 2), ';', 1) b, ',' as first_mark, cast(length(split_part(t, ',', 1)) + length(split_part(split_part(t, ',', 2), ';', 1)) + 3 as integer) as next_at, true as overflow
from (select p_partkey, p_brand || ',' || p_type || ';' || p_name as t from part)"""


@query(SQL_UNSTRING)
def unstring_pointer(spark: SparkSession, d: str) -> DataFrame:
    """UNSTRING by two delimiters into two fields, WITH POINTER: the rest of the text stands from the pointer on."""
    t = F.concat("p_brand", F.lit(","), "p_type", F.lit(";"), "p_name")
    got, marks, at, over = strings.unstring_from(t, 2, ",", ";")
    return read(spark, d, "part").select("p_partkey", got[0].alias("a"), got[1].alias("b"), marks[0].alias("first_mark"), at.alias("next_at"), over.alias("overflow"))


@query("""select c_custkey, cast(length(replace(split_part(c_name, '#', 1), 'e', 'ee')) - length(split_part(c_name, '#', 1)) as integer) as es, cast(length(c_name) - length(ltrim(replace(c_name, 'Customer#', ''), '0')) - 9 as integer) as zeros,
split_part(c_name, '#', 1) || '#' || replace(substr(c_name, 10), '0', '.') as dotted, upper(split_part(c_name, '#', 1)) || substr(c_name, 9) as uppers, translate(c_name, 'Cut', 'cUT') as converted from customer""")
def inspect_scopes(spark: SparkSession, d: str) -> DataFrame:
    """INSPECT with BEFORE and AFTER INITIAL, LEADING, and a function of each character."""
    n = F.col("c_name")
    return read(spark, d, "customer").select(
        "c_custkey",
        strings.tally(n, "ALL", "e", before="#").alias("es"),
        strings.tally(n, "LEADING", "0", after="#").alias("zeros"),
        strings.replaced(n, "ALL", "0", ".", after="#").alias("dotted"),
        strings.inspected(n, change=F.upper, before="#").alias("uppers"),
        strings.converted(n, "Cut", "cUT").alias("converted"),
    )


@query("select c_custkey, replace(translate(c_mktsegment, 'AB', 'ba'), 'b', '*') as text from customer")
def inspect_order(spark: SparkSession, d: str) -> DataFrame:
    """Several rules in one INSPECT: CONVERTING comes first."""
    return read(spark, d, "customer").select("c_custkey", strings.inspected(F.col("c_mktsegment"), converting=("AB", "ba"), replacing=(("ALL", "b", "*"),)).alias("text"))


@query("select p_partkey, round(sqrt(p_retailprice), 6) as root, round(ln(p_retailprice), 6) as log, round(log10(p_retailprice), 6) as log_ten, trim(' ' || p_brand || '  ') as brand, chr(64 + p_size % 26) as letter, lower(p_type) as low, cast(round((cast(p_retailprice as decimal(15,2)) + p_size) / 2, 6) as double) as mean, abs(20 - p_size) as distance from part")
def intrinsic_more(spark: SparkSession, d: str) -> DataFrame:
    price, size = money("p_retailprice"), F.col("p_size")
    rounded = lambda name, *a: F.round(intrinsics.call(name, *a).cast("double"), 6)
    return read(spark, d, "part").select(
        "p_partkey",
        rounded("SQRT", price).alias("root"),
        rounded("LOG", price).alias("log"),
        rounded("LOG10", price).alias("log_ten"),
        intrinsics.call("TRIM", F.concat(F.lit(" "), "p_brand", F.lit("  "))).alias("brand"),
        intrinsics.call("CHAR", 65 + size % 26).alias("letter"),
        intrinsics.call("LOWER-CASE", F.col("p_type")).alias("low"),
        rounded("MEAN", price, size.cast("decimal(15,2)")).alias("mean"),
        intrinsics.call("ABS", 20 - size).alias("distance"),
    )


@query("select 21 as current_size, true as current_is_digits, 21 as compiled_size")
def intrinsic_dates(spark: SparkSession, d: str) -> DataFrame:
    now, made = intrinsics.call("CURRENT-DATE"), intrinsics.call("WHEN-COMPILED")
    return spark.range(1).select(F.length(now).alias("current_size"), F.regexp_like(now, F.lit("^[0-9]{16}[+-][0-9]{4}$")).alias("current_is_digits"), F.length(made).alias("compiled_size"))


@query("select n_nationkey k, n_name as name from nation where n_regionkey = 2")
def sql_cursor_fetch(spark: SparkSession, d: str) -> DataFrame:
    """DECLARE, OPEN, FETCH to code 100 and CLOSE, row by row."""
    read(spark, d, "nation").createOrReplaceTempView("sql_nation")
    s, rows = Session(spark), []
    s.declare("C", "select n_nationkey k, n_name as name from sql_nation where n_regionkey = :REGION order by k")
    s.open("C", region=2)
    while (got := s.fetch("C")).code == 0:
        rows.append(tuple(got.value))
    if (got.code, s.close("C").code, s.fetch("C").code) != (100, 0, -501):
        raise ValueError("codes")
    return spark.createDataFrame(rows, "k int, name string")


@query("select n_nationkey, n_name from nation where n_regionkey <> 1 union all select 900, 'NEW'")
def sql_commit_rollback(spark: SparkSession, d: str) -> DataFrame:
    """INSERT and DELETE committed to a folder, then a change that is rolled back; another session finds what was committed."""
    name, at = f"sql_{uuid.uuid4().hex}", place(spark)
    read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").createOrReplaceTempView(name)
    with Session(spark, folder=at) as s:
        s.insert(name, spark.sql("select 900 n_nationkey, 'NEW' n_name, 0 n_regionkey"))
        s.delete(name, "n_regionkey = 1")
    s = Session(spark, folder=at)
    s.update(name, "n_nationkey > 0", n_name="'gone'")
    s.rollback()
    spark.catalog.dropTempView(name)
    Session(spark, folder=at)
    return spark.table(name).select("n_nationkey", "n_name")


@query("select * from (values ('found', 0, '00000', 1, ' '), ('missing', 100, '02000', 0, 'W'), ('several', -811, '21000', 2, ' '), ('wrong', -1, '42703', 0, ' '), ('update', 0, '00000', 5, ' '), ('no update', 100, '02000', 0, 'W')) t(step, code, state, n, warning)")
def sql_communication_area(spark: SparkSession, d: str) -> DataFrame:
    """SQLCODE, SQLSTATE, rows and SQLWARN after each kind of statement."""
    read(spark, d, "nation").createOrReplaceTempView("sql_area")
    s, into = Session(spark, strict=True), "select n_name into :N from sql_area where "
    steps = {"found": s.select_into(into + "n_nationkey = 3"), "missing": s.select_into(into + "n_nationkey = 999"), "several": s.select_into(into + "n_regionkey = 1"), "wrong": s.select_into(into + "no_such = 1")}
    steps |= {"update": s.update("sql_area", "n_regionkey = 1", n_name="'x'"), "no update": s.update("sql_area", "n_regionkey = 99", n_name="'x'")}
    return spark.createDataFrame([(k, r.code, r.state, r.rows, r.warning) for k, r in steps.items()], "step string, code int, state string, n int, warning string")


def _program(data: str, body: str, files: str = "", records: str = "", special: str = "") -> str:
    head = f"IDENTIFICATION DIVISION.\nPROGRAM-ID. Q.\nENVIRONMENT DIVISION.\n{'CONFIGURATION SECTION. SPECIAL-NAMES. ' + special if special else ''}\n"
    head += f"INPUT-OUTPUT SECTION.\nFILE-CONTROL.\n{files}\n" if files else ""
    return head + "DATA DIVISION.\n" + (f"FILE SECTION.\n{records}\n" if records else "") + f"WORKING-STORAGE SECTION.\n{data}\nPROCEDURE DIVISION.\nMAIN-PARA.\n{body}\n"


def _shown(spark: SparkSession, p: Program) -> DataFrame:
    """What a program displayed, line by line."""
    return spark.createDataFrame([(i, s.rstrip()) for i, s in enumerate(p.display, 1)], "n int, line string")


def _lines(*shown: str) -> str:
    return "select * from (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(shown, 1)) + ") t(n, line)"


KEYED_FILES = """    SELECT IN-FILE ASSIGN TO NATIONS.
    SELECT KEYS ASSIGN TO KEYS ORGANIZATION IS INDEXED RECORD KEY IS N-KEY FILE STATUS IS ST.
    SELECT OUT-FILE ASSIGN TO OUT."""
KEYED_RECORDS = """FD IN-FILE. 01 IN-REC. 05 N-NATIONKEY PIC 9(4). 05 N-NAME PIC X(20).
FD KEYS. 01 KEY-REC. 05 N-KEY PIC 9(4). 05 NAME PIC X(20).
FD OUT-FILE. 01 OUT-REC. 05 K PIC 9(4). 05 NAME PIC X(20)."""
KEYED = _program(
    "01 ST PIC XX. 01 E PIC X VALUE 'N'.",
    """    OPEN INPUT IN-FILE OUTPUT KEYS.
    PERFORM UNTIL E = 'Y'
      READ IN-FILE AT END MOVE 'Y' TO E
        NOT AT END MOVE N-NATIONKEY TO N-KEY MOVE N-NAME TO NAME OF KEY-REC WRITE KEY-REC END-READ
    END-PERFORM.
    CLOSE IN-FILE KEYS.
    OPEN I-O KEYS. DISPLAY 'OPEN ' ST.
    MOVE 3 TO N-KEY. MOVE 'CHANGED' TO NAME OF KEY-REC. REWRITE KEY-REC. DISPLAY 'REWRITE ' ST.
    MOVE 4 TO N-KEY. DELETE KEYS RECORD. DISPLAY 'DELETE ' ST.
    DELETE KEYS RECORD INVALID KEY DISPLAY 'DELETE AGAIN ' ST END-DELETE.
    MOVE 5 TO N-KEY. WRITE KEY-REC INVALID KEY DISPLAY 'WRITE ' ST END-WRITE.
    MOVE 900 TO N-KEY. MOVE 'NEW' TO NAME OF KEY-REC. WRITE KEY-REC. DISPLAY 'WRITE ' ST.
    MOVE 2 TO N-KEY. START KEYS KEY IS GREATER THAN N-KEY. READ KEYS NEXT RECORD. DISPLAY 'AFTER 2: ' N-KEY.
    MOVE 1 TO N-KEY. READ KEYS KEY IS N-KEY INVALID KEY DISPLAY 'LOST' NOT INVALID KEY DISPLAY 'BEFORE START ' ST END-READ.
    OPEN I-O KEYS. DISPLAY 'OPEN AGAIN ' ST.
    CLOSE KEYS. MOVE 'N' TO E. OPEN INPUT KEYS OUTPUT OUT-FILE.
    PERFORM UNTIL E = 'Y'
      READ KEYS NEXT RECORD AT END MOVE 'Y' TO E
        NOT AT END MOVE N-KEY TO K MOVE NAME OF KEY-REC TO NAME OF OUT-REC WRITE OUT-REC END-READ
    END-PERFORM.
    WRITE KEY-REC INVALID KEY DISPLAY 'WRITE TO INPUT ' ST END-WRITE.
    CLOSE KEYS OUT-FILE. STOP RUN.""",
    KEYED_FILES,
    KEYED_RECORDS,
)


def _keyed(spark: SparkSession, d: str) -> Program:
    nations = read(spark, d, "nation").select(F.col("n_nationkey"), F.col("n_name"))
    return Program(KEYED).run(spark, tables={"IN-FILE": nations}, paths={"KEYS": place(spark), "OUT": None})


@query("select n_nationkey k, case when n_nationkey = 3 then 'CHANGED' else n_name end as name from nation where n_nationkey <> 4 union all select 900, 'NEW'")
def cobol_keyed_file(spark: SparkSession, d: str) -> DataFrame:
    """A keyed file that a program writes, changes in mode I-O, closes and reads again."""
    p = _keyed(spark, d)
    return p.output(p.files["OUT_FILE"]).toDF("k", "name").select(F.col("k").cast("int").alias("k"), F.rtrim("name").alias("name"))


@query(_lines("OPEN 00", "REWRITE 00", "DELETE 00", "DELETE AGAIN 23", "WRITE 22", "WRITE 00", "AFTER 2: 3", "BEFORE START 00", "OPEN AGAIN 41", "WRITE TO INPUT 37"))
def cobol_file_status(spark: SparkSession, d: str) -> DataFrame:
    """FILE STATUS after each verb of that program."""
    return _shown(spark, _keyed(spark, d))


FLAT = _program(
    "01 E PIC X VALUE 'N'.",
    """    OPEN I-O CUSTOMERS.
    PERFORM UNTIL E = 'Y'
      READ CUSTOMERS AT END MOVE 'Y' TO E
        NOT AT END IF BALANCE < 0 MOVE 0 TO BALANCE MOVE 'CLEARED' TO REMARK REWRITE C-REC END-IF END-READ
    END-PERFORM.
    CLOSE CUSTOMERS. STOP RUN.""",
    "    SELECT CUSTOMERS ASSIGN TO C.",
    "FD CUSTOMERS. 01 C-REC. 05 K PIC 9(9). 05 BALANCE PIC S9(9)V99. 05 REMARK PIC X(8).",
)


@query("select c_custkey k, cast(greatest(b, 0) as decimal(11,2)) balance, case when b < 0 then 'CLEARED' else '' end as remark from (select c_custkey, cast(c_acctbal as decimal(11,2)) - 4000 as b from customer)")
def cobol_rewrite_loop(spark: SparkSession, d: str) -> DataFrame:
    """A loop that reads a file and rewrites some of its records: one pass over the file."""
    x = read(spark, d, "customer").selectExpr("c_custkey k", "cast(c_acctbal as decimal(11,2)) - 4000 balance")
    p = Program(FLAT).run(spark, tables={"CUSTOMERS": x})
    if any(v.level != "INFO" for v in p.diagnostics):
        raise ValueError(p.diagnostics)
    out = p.files["CUSTOMERS"].data
    return out.select(F.col("K").cast("long").alias("k"), F.col("BALANCE").alias("balance"), F.rtrim("REMARK").alias("remark"))


ORDERS_IN = "FD ORDERS. 01 O-REC. 05 O-ORDERKEY PIC 9(12). 05 O-CUSTKEY PIC 9(9). 05 O-TOTALPRICE PIC S9(9)V99. 05 O-ORDERSTATUS PIC X. 88 IS-OPEN VALUE 'O'. 05 O-ORDERPRIORITY PIC X(15)."


def _looped(spark: SparkSession, d: str, data: str, out: str, body: str, paragraphs: str = "", **options) -> DataFrame:
    """What a program writes to OUT for each order."""
    loop = f"""    OPEN INPUT ORDERS OUTPUT OUT-FILE.
    PERFORM UNTIL E = 'Y'
      READ ORDERS AT END MOVE 'Y' TO E NOT AT END {body} WRITE OUT-REC END-READ
    END-PERFORM.
    CLOSE ORDERS OUT-FILE. STOP RUN.
{paragraphs}"""
    text = _program(f"01 E PIC X VALUE 'N'. {data}", loop, "    SELECT ORDERS ASSIGN TO O. SELECT OUT-FILE ASSIGN TO OUT.", f"{ORDERS_IN}\nFD OUT-FILE. 01 OUT-REC. {out}")
    x = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(11,2)").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    p = Program(text).run(spark, tables={"ORDERS": x}, paths={"OUT": None}, **options)
    if any(v.level != "INFO" for v in p.diagnostics):
        raise ValueError(p.diagnostics)
    return p.output(p.files["OUT_FILE"])


@query("""select o_orderkey k, cast(p - 100.25 - 2 as decimal(11,2)) less, cast(p * 3 as decimal(13,2)) thrice, cast((cast(p * 100 as bigint) // 7) * 0.01 as decimal(11,2)) seventh, cast(o_custkey + 5 + 7 as decimal(9,0)) summed, cast(o_custkey + 5 + 7 as decimal(9,0)) again
from (select o_orderkey, o_custkey, cast(o_totalprice as decimal(11,2)) p from orders)""")
def cobol_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """SUBTRACT GIVING of several, MULTIPLY GIVING, DIVIDE INTO GIVING, and ADD of several GIVING two fields, in a loop."""
    body = "MOVE O-ORDERKEY TO K SUBTRACT 100.25 2 FROM O-TOTALPRICE GIVING LESS-X MULTIPLY O-TOTALPRICE BY 3 GIVING THRICE DIVIDE 7 INTO O-TOTALPRICE GIVING SEVENTH ADD O-CUSTKEY 5 7 GIVING SUMMED AGAIN"
    out = _looped(spark, d, "", "05 K PIC 9(12). 05 LESS-X PIC S9(9)V99. 05 THRICE PIC S9(11)V99. 05 SEVENTH PIC S9(9)V99. 05 SUMMED PIC 9(9). 05 AGAIN PIC 9(9).", body)
    return out.toDF("k", "less", "thrice", "seventh", "summed", "again").withColumn("k", F.col("k").cast("long"))


@query("""select o_orderkey k, lpad(cast(o_custkey as varchar), 9, '0') || '   ' as text, lpad(cast(o_orderkey as varchar), 12, '0') || lpad(cast(o_custkey as varchar), 9, '0') || rpad(o_orderstatus, 1, ' ') as both_keys, rpad(substr(o_orderpriority, 3, 4), 4, ' ') as part, rpad(substr(o_orderpriority, 1, 1) || '-' || o_orderstatus, 6, ' ') as joined from orders""")
def cobol_moves(spark: SparkSession, d: str) -> DataFrame:
    """MOVE of a number to text, of a group, reference modification and concatenation, in a loop."""
    data = "01 G. 05 G-K PIC 9(12). 05 G-C PIC 9(9). 05 G-S PIC X."
    body = "MOVE O-ORDERKEY TO K G-K MOVE O-CUSTKEY TO TEXT-X G-C MOVE O-ORDERSTATUS TO G-S MOVE G TO BOTH-X MOVE O-ORDERPRIORITY(3:4) TO PART-X MOVE O-ORDERPRIORITY(1:1) & '-' & O-ORDERSTATUS TO JOINED"
    out = _looped(spark, d, data, "05 K PIC 9(12). 05 TEXT-X PIC X(12). 05 BOTH-X PIC X(22). 05 PART-X PIC X(4). 05 JOINED PIC X(6).", body)
    return out.toDF("k", "text", "both_keys", "part", "joined").withColumn("k", F.col("k").cast("long"))


@query("""select o_orderkey k, case when (o_orderstatus = 'O' or o_orderstatus = 'F') and not p < 100000 then 'A' when p between 50000 and 60000 or o_orderpriority = '1-URGENT' then 'B' else 'C' end as class, case when p > 150000 then 'HIGH' when p = 0 then 'ZERO' else 'LOW' end as grade
from (select o_orderkey, o_orderstatus, o_orderpriority, cast(o_totalprice as decimal(11,2)) p from orders)""")
def cobol_conditions(spark: SparkSession, d: str) -> DataFrame:
    """AND, OR, NOT, word forms, abbreviated conditions, figurative constants, IF and EVALUATE, in a loop."""
    body = """MOVE O-ORDERKEY TO K
        EVALUATE TRUE
          WHEN (IS-OPEN OR O-ORDERSTATUS EQUAL TO 'F') AND NOT O-TOTALPRICE LESS THAN 100000 MOVE 'A' TO CLASS-X
          WHEN O-TOTALPRICE >= 50000 AND <= 60000 OR O-ORDERPRIORITY = '1-URGENT' MOVE 'B' TO CLASS-X
          WHEN OTHER MOVE 'C' TO CLASS-X
        END-EVALUATE
        IF O-TOTALPRICE IS GREATER THAN 150000 MOVE 'HIGH' TO GRADE ELSE IF O-TOTALPRICE = ZEROS MOVE 'ZERO' TO GRADE ELSE MOVE 'LOW' TO GRADE END-IF END-IF"""
    out = _looped(spark, d, "", "05 K PIC 9(12). 05 CLASS-X PIC X. 05 GRADE PIC X(4).", body)
    return out.toDF("k", "class", "grade").select(F.col("k").cast("long").alias("k"), "class", F.rtrim("grade").alias("grade"))


@query("""select o_orderkey k, substr(o_orderpriority, 1, 1) as a, rpad(substr(o_orderpriority, 3), 12, ' ') as b, cast(2 as decimal(2,0)) pieces, cast(length(o_orderpriority) - length(replace(o_orderpriority, 'E', '')) as decimal(3,0)) es, cast(1 as decimal(3,0)) digits from orders where o_orderpriority like '_-%'""")
def cobol_strings(spark: SparkSession, d: str) -> DataFrame:
    """UNSTRING TALLYING, and INSPECT with several counters, in a loop."""
    body = """MOVE O-ORDERKEY TO K MOVE SPACES TO A B MOVE 0 TO PIECES ES DIGITS
        UNSTRING O-ORDERPRIORITY DELIMITED BY '-' INTO A B TALLYING IN PIECES END-UNSTRING
        INSPECT O-ORDERPRIORITY TALLYING ES FOR ALL 'E' DIGITS FOR CHARACTERS BEFORE INITIAL '-'"""
    out = _looped(spark, d, "", "05 K PIC 9(12). 05 A PIC X. 05 B PIC X(12). 05 PIECES PIC 9(2). 05 ES PIC 9(3). 05 DIGITS PIC 9(3).", body)
    return out.toDF("k", "a", "b", "pieces", "es", "digits").withColumn("k", F.col("k").cast("long"))


@query(_lines("LOOPS 4 6 3 21", "TWICE", "TWICE", "ODD 1", "ODD 3", "LAST 4", "THRU", "JUMPED 2", "POINTER 05 cc", "COUNT 2 2", "ACCEPT hello", "RATE 12"))
def cobol_control(spark: SparkSession, d: str) -> DataFrame:
    """PERFORM in its forms, EXIT PERFORM, CYCLE, GO TO, UNSTRING with POINTER and COUNT, ACCEPT and INVOKE."""
    data = """01 I PIC 9(2). 01 J PIC 9(2). 01 N PIC 9(2) VALUE 0. 01 M PIC 9(2) VALUE 0. 01 S PIC 9(3) VALUE 0. 01 P PIC 9(2) VALUE 3. 01 C1 PIC 9. 01 C2 PIC 9.
01 T PIC X(8) VALUE 'aabbcc'. 01 U PIC X(8). 01 W PIC X(12) VALUE 'xx,yy'. 01 W1 PIC X(4). 01 W2 PIC X(4). 01 L PIC X(5). 01 R PIC 9(2)."""
    body = """    PERFORM 4 TIMES ADD 1 TO N END-PERFORM.
    PERFORM VARYING I FROM 1 BY 1 UNTIL I > 2 AFTER J FROM 1 BY 1 UNTIL J > 3 ADD 1 TO M END-PERFORM.
    MOVE 0 TO I. PERFORM WITH TEST AFTER UNTIL I >= 3 ADD 1 TO I END-PERFORM.
    PERFORM VARYING J FROM 1 BY 1 UNTIL J > 6 ADD J TO S END-PERFORM.
    DISPLAY 'LOOPS ' N ' ' M ' ' I ' ' S.
    PERFORM SAY 2 TIMES.
    PERFORM VARYING I FROM 1 BY 1 UNTIL I > 9
      IF I = 2 EXIT PERFORM CYCLE END-IF
      IF I = 4 EXIT PERFORM END-IF
      DISPLAY 'ODD ' I
    END-PERFORM.
    DISPLAY 'LAST ' I. PERFORM FIRST-X THRU SECOND-X. MOVE 2 TO N. GO TO A-X B-X DEPENDING ON N.
SAY. DISPLAY 'TWICE'.
FIRST-X. GO TO SECOND-X.
MIDDLE-X. DISPLAY 'NOT HERE'.
SECOND-X. DISPLAY 'THRU'.
A-X. DISPLAY 'JUMPED 1'.
B-X. DISPLAY 'JUMPED 2'.
C-X.
    MOVE 5 TO P. UNSTRING T DELIMITED BY 'x' INTO U WITH POINTER P. DISPLAY 'POINTER 05 ' U.
    UNSTRING W DELIMITED BY ',' INTO W1 COUNT IN C1 W2. UNSTRING W DELIMITED BY ',' INTO W2 COUNT IN C2. DISPLAY 'COUNT ' C1 ' ' C2.
    ACCEPT L. DISPLAY 'ACCEPT ' L.
    INVOKE TARIFF 'rate' USING 5 7 RETURNING R. DISPLAY 'RATE ' R. STOP RUN."""
    text = _program(data + " 01 TARIFF PIC X.", body)
    return _shown(spark, Program(text).run(spark, inputs=["hello"], methods={"TARIFF.RATE": lambda a, b: a + b}))


@query(_lines("65", "NONE", "AA BB  07", "GROUPS 12 05 X", "SUMS 15 12", "EURO  1.234,50", "BACK 1234.50", "SORTED 0"))
def cobol_names_and_calls(spark: SparkSession, d: str) -> DataFrame:
    """CALL by reference and by content, COPY REPLACING, qualified names with CORRESPONDING, SPECIAL-NAMES and registers."""
    sub = Program("IDENTIFICATION DIVISION.\nPROGRAM-ID. SUB.\nDATA DIVISION.\nLINKAGE SECTION.\n01 A PIC 9(3).\n01 B PIC 9(3).\nPROCEDURE DIVISION USING A B.\nP1.\n    ADD 1 TO A. ADD 1 TO B. GOBACK.\n")
    data = """01 A PIC 9(3) VALUE 5. 01 B PIC 9(3) VALUE 5.
COPY PERSON REPLACING ==:TAG:== BY ==IN==. COPY PERSON REPLACING ==:TAG:== BY ==OUT==.
01 OLD-X. 05 QTY PIC 9(2) VALUE 12. 05 SUB-X. 10 CODE-X PIC 9(2) VALUE 5. 05 ONLY-OLD PIC X VALUE 'X'.
01 NEW-X. 05 SUB-X. 10 CODE-X PIC 9(2). 05 QTY PIC 9(2). 05 ONLY-NEW PIC X VALUE 'X'.
01 ADD-X. 05 QTY PIC 9(2) VALUE 3. 05 TOTAL PIC 9(2) VALUE 1.
01 PRICE PIC S9(5)V99 VALUE 1234,50. 01 SHOWN PIC ZZ.ZZ9,99. 01 PLAIN PIC S9(5)V99."""
    body = """    CALL 'SUB' USING A BY CONTENT B. DISPLAY A B. CALL 'NO' ON EXCEPTION DISPLAY 'NONE' END-CALL.
    MOVE 'AA' TO IN-NAME. MOVE 'BB' TO OUT-NAME. MOVE 7 TO OUT-AGE. DISPLAY IN-NAME OUT-NAME ' ' '0' OUT-AGE.
    MOVE CORRESPONDING OLD-X TO NEW-X. DISPLAY 'GROUPS ' QTY OF NEW-X ' ' '0' CODE-X OF SUB-X OF NEW-X ' ' ONLY-NEW.
    ADD CORRESPONDING ADD-X TO NEW-X. DISPLAY 'SUMS ' QTY IN NEW-X ' ' QTY IN OLD-X.
    MOVE PRICE TO SHOWN. DISPLAY 'EURO ' SHOWN. MOVE SHOWN TO PLAIN. DISPLAY 'BACK ' PLAIN. DISPLAY 'SORTED ' SORT-RETURN."""
    p = Program(_program(data, body, special="DECIMAL-POINT IS COMMA."), [COPYBOOKS]).run(spark, programs={"SUB": sub})
    return _shown(spark, p)


PAYROLL = _program(
    "01 E PIC X VALUE 'N'. 01 EXTRA PIC S9(7)V99. 01 TAX-RATE PIC SV9(4) VALUE 0.2200. 01 ALL-NET PIC S9(13)V99 VALUE 0.",
    """    OPEN INPUT STAFF OUTPUT PAID.
    PERFORM UNTIL E = 'Y'
      READ STAFF AT END MOVE 'Y' TO E NOT AT END PERFORM PAY-ONE END-READ
    END-PERFORM.
    CLOSE STAFF PAID. DISPLAY ALL-NET. STOP RUN.
PAY-ONE.
    COMPUTE GROSS = HOURS * RATE. MOVE 0 TO EXTRA.
    IF HOURS > 40 COMPUTE EXTRA = (HOURS - 40) * RATE * 0.5 END-IF.
    ADD EXTRA TO GROSS. COMPUTE TAX ROUNDED = GROSS * TAX-RATE. SUBTRACT TAX FROM GROSS GIVING NET.
    ADD NET TO ALL-NET. MOVE S-KEY TO K. WRITE P-REC.""",
    "    SELECT STAFF ASSIGN TO S. SELECT PAID ASSIGN TO P.",
    "FD STAFF. 01 S-REC. 05 S-KEY PIC 9(9). 05 HOURS PIC 9(3). 05 RATE PIC S9(3)V99.\nFD PAID. 01 P-REC. 05 K PIC 9(9). 05 GROSS PIC S9(7)V99. 05 TAX PIC S9(7)V99. 05 NET PIC S9(7)V99.",
)


@query("""select k, cast(g as decimal(9,2)) gross, cast(round(g * 0.22, 2) as decimal(9,2)) tax, cast(g - round(g * 0.22, 2) as decimal(9,2)) net
from (select k, cast(cast(trunc(h * r * 100) as decimal(18,0)) * 0.01 as decimal(12,2)) + case when h > 40 then cast(cast(trunc((h - 40) * r * 50) as decimal(18,0)) * 0.01 as decimal(12,2)) else 0 end as g
from (select c_custkey k, cast(c_custkey % 60 as decimal(3,0)) h, cast(abs(cast(c_acctbal as decimal(15,2))) % 100 as decimal(5,2)) r from customer))""")
def cobol_program_payroll(spark: SparkSession, d: str) -> DataFrame:
    """A payroll: gross with overtime, tax rounded, net, and their total."""
    staff = read(spark, d, "customer").select(F.col("c_custkey").alias("s_key"), (F.col("c_custkey") % 60).alias("hours"), (F.abs(money("c_acctbal")) % 100).cast("decimal(5,2)").alias("rate"))
    p = Program(PAYROLL).run(spark, tables={"STAFF": staff}, paths={"P": None})
    if any(v.level != "INFO" for v in p.diagnostics):
        raise ValueError(p.diagnostics)
    return p.output(p.files["PAID"]).toDF("k", "gross", "tax", "net").withColumn("k", F.col("k").cast("long"))


SORTED = """    SELECT ORDERS ASSIGN TO O. SELECT W ASSIGN TO W. SELECT OUT-FILE ASSIGN TO OUT."""


@query("select o_custkey c, count(*) n from orders where cast(o_totalprice as decimal(11,2)) > 100000 group by 1")
def cobol_sort_procedures(spark: SparkSession, d: str) -> DataFrame:
    """SORT with an INPUT and an OUTPUT PROCEDURE in a program, both loops lowered to plans."""
    body = """    OPEN INPUT ORDERS OUTPUT OUT-FILE.
    SORT W ON ASCENDING KEY W-C INPUT PROCEDURE IS PUT-X OUTPUT PROCEDURE IS GET-X. CLOSE ORDERS OUT-FILE. STOP RUN.
PUT-X.
    PERFORM UNTIL E = 'Y'
      READ ORDERS AT END MOVE 'Y' TO E NOT AT END IF O-TOTALPRICE > 100000 MOVE O-CUSTKEY TO W-C RELEASE W-REC END-IF END-READ
    END-PERFORM.
GET-X.
    PERFORM UNTIL E2 = 'Y'
      RETURN W AT END MOVE 'Y' TO E2 NOT AT END MOVE W-C TO K WRITE OUT-REC END-RETURN
    END-PERFORM."""
    text = _program("01 E PIC X VALUE 'N'. 01 E2 PIC X VALUE 'N'.", body, SORTED, f"{ORDERS_IN}\nSD W. 01 W-REC. 05 W-C PIC 9(9).\nFD OUT-FILE. 01 OUT-REC. 05 K PIC 9(9).")
    x = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(11,2)").alias("o_totalprice"))
    p = Program(text).run(spark, tables={"ORDERS": x}, paths={"OUT": None})
    return p.output(p.files["OUT_FILE"]).groupBy(F.col("K").cast("long").alias("c")).agg(F.count("*").alias("n"))


@query("select n_nationkey k, n_name as text from nation where n_nationkey % 3 <> 2")
def port_send_receive(spark: SparkSession, d: str) -> DataFrame:
    """A port with EBCDIC on the wire: three batches sent, one received and rolled back, two received and committed."""
    x = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("text"))
    port = Port(spark, place(spark), "cp037")
    for i in range(3):
        port.send(x.where(f"k % 3 = {i}"))
    port.receive()
    port.rollback()
    got = []
    for _ in range(2):
        got.append(port.receive(timeout=5))
        port.commit()
    if len(port.waiting()) != 1:
        raise ValueError(port.waiting())
    kept = [spark.read.parquet(f"{port.folder}/done-{i:012}") for i in (1, 2)]
    from ..sources import codec

    out = kept[0].unionByName(kept[1])
    return out.withColumn("text", codec.to_text(F.col("text"), "cp037"))


@query("select 'fire and forget' as mode, 0 as n, 3 as batches union all select 'at least once', 25, 3 union all select 'exactly once', 25, 3")
def port_modes(spark: SparkSession, d: str) -> DataFrame:
    """Three batches to a function that fails at first, in each mode of delivery: rows and batches that were done."""
    x, rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("text")), []
    for mode in ("fire and forget", "at least once", "exactly once"):
        port, tries, done = Port(spark, place(spark)), [], []
        for i in range(3):
            port.send(x.where(f"k % 3 = {i}"))

        def work(df: DataFrame, mode: str = mode, tries: list = tries, done: list = done) -> None:
            tries.append(1)
            if mode == "fire and forget" or mode == "at least once" and len(tries) < 3:
                raise RuntimeError("again")
            done.append(df.count())

        rows.append((mode, 0, 0, port.work(work, mode, pause=0.0), done))
    return spark.createDataFrame([(m, sum(done), n) for m, _, _, n, done in rows], "mode string, n int, batches int")


@query("select queue, item, data from (values ('A', 1, 'x'), ('A', 2, 'y'), ('A', 3, 'w'), ('B', 1, 'again')) t(queue, item, data)")
def queue_items(spark: SparkSession, d: str) -> DataFrame:
    """Temporary storage queues in a folder: items numbered by queue, a queue deleted and begun anew, another driver that goes on."""
    at, schema = place(spark), "queue string, seq int, data string"
    q = Queues(spark, at)
    q.write(spark.createDataFrame([("A", 2, "y"), ("A", 1, "x"), ("B", 1, "z")], schema))
    q.delete("B")
    Queues(spark, at).write(spark.createDataFrame([("A", 1, "w"), ("B", 1, "again")], schema))
    return Queues(spark, at).items.withColumn("item", F.col("item").cast("int"))


@query("""select event_id, case event_type when 'click' then 'CLICK' when 'view' then 'view!' else event_type end commarea, case event_type when 'click' then 0 when 'view' then 0 when 'purchase' then case when user_id < 50 then 0 else 13 end when 'error' then 27 else 28 end code from events""")
def region_programs(spark: SparkSession, d: str) -> DataFrame:
    """LINK, a file resource read by key, and the response codes of conditions; a program deployed from a folder while it runs."""
    region, e = Region(), read(spark, d, "events")
    users = spark.range(50).withColumnRenamed("id", "user_id")
    region.define("UPPER", lambda df: df.withColumn("commarea", F.upper("commarea")))
    region.register("click", lambda df: region.link("UPPER", df))
    region.rule("view", lambda c: F.concat(c, F.lit("!")))
    region.resources["USERS"] = users
    region.register("purchase", lambda df: region.read_file(df, "USERS", "user_id"))
    region.register("error", lambda df: region.link("NOWHERE", df))
    out = region.dispatch(e.select("event_id", "user_id", F.col("event_type").alias("trans_id"), F.col("event_type").alias("commarea")))
    return out.select("event_id", "commarea", response(F.col("condition")).alias("code"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) n, cast(sum(cast(value as decimal(15,2))) as decimal(25,2)) total from events group by 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows by event time with a watermark; the newest result of each window."""
    at = place(spark)
    totals = windows.windowed(_stream(spark, d), "ts", "1 hour", "1 day", "event_type", n=F.count("*"), total=F.sum(money("value")).cast("decimal(25,2)"))
    windows.kept(totals, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return windows.newest(spark, f"{at}/out", "start", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
 s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, count(*) n from s group by user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows by user: half an hour without an event ends one."""
    at = place(spark)
    totals = windows.sessions(_stream(spark, d), "ts", "30 minutes", "1 day", "user_id", n=F.count("*"))
    windows.kept(totals, f"{at}/out", f"{at}/checkpoint", "complete").awaitTermination()
    out = windows.newest(spark, f"{at}/out", "user_id", "start", "end")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select count(*) n from events")
def stream_listen(spark: SparkSession, d: str) -> DataFrame:
    """A listener that is exactly once over restarts by its marks: started twice, each batch is done once."""
    at = place(spark)
    for _ in range(2):
        listen(_stream(spark, d), lambda b: b.write.mode("append").parquet(f"{at}/out"), f"{at}/checkpoint", "exactly once").awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n"))
