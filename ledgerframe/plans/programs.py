"""Queries that are COBOL programs over the standard tables, and streams of events through ports and regions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cobol import Program
from ..streaming.ports import Region, delivered, shared_folder
from .catalog import query, read

LINES = """
IDENTIFICATION DIVISION.
PROGRAM-ID. LINES.
ENVIRONMENT DIVISION.
INPUT-OUTPUT SECTION.
FILE-CONTROL.
    SELECT LINE-FILE ASSIGN TO LINES.
    SELECT OUT-FILE ASSIGN TO OUT.
DATA DIVISION.
FILE SECTION.
FD LINE-FILE.
01 LINE-REC.
   05 L-ORDERKEY PIC 9(12).
   05 L-LINENUMBER PIC 9(3).
   05 L-QUANTITY PIC S9(7)V99.
   05 L-EXTENDEDPRICE PIC S9(11)V99.
   05 L-DISCOUNT PIC S9(3)V99.
   05 L-RETURNFLAG PIC X.
      88 RETURNED VALUE 'R'.
FD OUT-FILE.
01 OUT-REC.
   05 ORDERKEY PIC 9(12).
   05 LINENUMBER PIC 9(3).
   05 NET PIC S9(11)V99.
   05 CLASS-X PIC X(8).
WORKING-STORAGE SECTION.
01 AT-END PIC X VALUE 'N'.
01 ITEMS PIC 9(12) VALUE 0.
01 RETURNS PIC 9(12) VALUE 0.
01 QUANTITY PIC S9(15)V99 VALUE 0.
01 TOTAL-NET PIC S9(15)V99 VALUE 0.
01 TOP-PRICE PIC S9(11)V99 VALUE 0.
PROCEDURE DIVISION.
MAIN-PARA.
    OPEN INPUT LINE-FILE OUTPUT OUT-FILE.
    PERFORM UNTIL AT-END = 'Y'
      READ LINE-FILE
        AT END MOVE 'Y' TO AT-END
        NOT AT END PERFORM ONE-LINE
      END-READ
    END-PERFORM.
    CLOSE LINE-FILE OUT-FILE.
    STOP RUN.
ONE-LINE.
    ADD 1 TO ITEMS.
    ADD L-QUANTITY TO QUANTITY.
    COMPUTE NET = L-EXTENDEDPRICE * (1 - L-DISCOUNT).
    ADD L-EXTENDEDPRICE TO TOTAL-NET.
    IF L-EXTENDEDPRICE > TOP-PRICE MOVE L-EXTENDEDPRICE TO TOP-PRICE END-IF.
    EVALUATE TRUE
      WHEN RETURNED ADD 1 TO RETURNS MOVE 'RETURNED' TO CLASS-X
      WHEN L-QUANTITY >= 25 MOVE 'BULK' TO CLASS-X
      WHEN OTHER MOVE 'SINGLE' TO CLASS-X
    END-EVALUATE.
    MOVE L-ORDERKEY TO ORDERKEY.
    MOVE L-LINENUMBER TO LINENUMBER.
    IF L-DISCOUNT > 0.02 WRITE OUT-REC END-IF.
"""
_P, _Q, _D = (f"cast({c} as decimal(15,2))" for c in ("l_extendedprice", "l_quantity", "l_discount"))


def _ran(spark: SparkSession, d: str) -> Program:
    money = {c: F.col(c).cast("decimal(15,2)") for c in ("l_quantity", "l_extendedprice", "l_discount")}
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag").withColumns(money)
    return Program(LINES).run(spark, tables={"LINE-FILE": lines}, paths={"OUT": None})


@query(f"select cast(l_orderkey as decimal(12,0)) orderkey, cast(l_linenumber as decimal(3,0)) linenumber, cast(trunc({_P} * (1 - {_D}) * 100) * 0.01 as decimal(13,2)) net, rpad(case when l_returnflag = 'R' then 'RETURNED' when {_Q} >= 25 then 'BULK' else 'SINGLE' end, 8, ' ') as class from lineitem where {_D} > 0.02")
def cobol_program_lines(spark: SparkSession, d: str) -> DataFrame:
    p = _ran(spark, d)
    return p.output(p.files["OUT_FILE"]).toDF("orderkey", "linenumber", "net", "class")


@query(f"select count(*) items, count(*) filter (where l_returnflag = 'R') as returned, cast(sum({_Q}) as decimal(17,2)) quantity, cast(sum({_P}) as decimal(17,2)) total, max({_P}) top from lineitem")
def cobol_program_totals(spark: SparkSession, d: str) -> DataFrame:
    p = _ran(spark, d)
    row = [p.get(("ref", n, [], None)).value for n in ("ITEMS", "RETURNS", "QUANTITY", "TOTAL_NET", "TOP_PRICE")]
    return spark.createDataFrame([(int(row[0]), int(row[1]), *row[2:])], "items long, returned long, quantity decimal(17,2), total decimal(17,2), top decimal(15,2)")


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a stream's source is a folder or a pattern


@query("select event_type, count(*) n from events group by 1")
def message_port_drain(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/port-{uuid.uuid4().hex}"
    delivered(_events(spark, d), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("select event_id, case when event_type = 'click' then upper(event_type) else event_type end commarea, case when event_type in ('click', 'view') then 'NORMAL' else 'TRANSIDERR' end condition from events")
def region_dispatch(spark: SparkSession, d: str) -> DataFrame:
    region = Region()
    region.rule("click", F.upper)
    region.rule("view", lambda commarea: commarea)
    requests = read(spark, d, "events").select("event_id", F.col("event_type").alias("trans_id"), F.col("event_type").alias("commarea"))
    return region.dispatch(requests).select("event_id", "commarea", "condition")
