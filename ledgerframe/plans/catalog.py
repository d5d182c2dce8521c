"""The named queries. Doubles are cast once to DECIMAL(15,2), in Spark and in SQL alike; every column has a name and a type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions, edited, intrinsics, numeric, strings
from ..operators import records
from ..picture import BINARY, PACKED, Field, Layout, picture
from ..sources import codec, files
from ..sql import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(15,2)")


def kept(c: str, p: int, s: int = 2) -> Column:
    return F.col(c).cast(f"decimal({p},{s})")


_P, _Q = "cast(l_extendedprice as decimal(15,2))", "cast(l_quantity as decimal(15,2))"
_D = "cast(l_discount as decimal(15,2))"
_TRUNC = f"cast(trunc({_P} * (1 - {_D}) * 100) as decimal(18,0)) * 0.01"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").withColumns({"price": money("l_extendedprice"), "qty": money("l_quantity"), "disc": money("l_discount")})


@query(f"select s_suppkey, s_name, count(*) items, cast(sum({_Q}) as decimal(25,2)) quantity, cast(sum({_TRUNC}) as decimal(28,2)) amount, max(l_shipdate) last_shipment from lineitem join supplier on l_suppkey = s_suppkey group by s_suppkey, s_name")
def supplier_shipment_summary(spark: SparkSession, d: str) -> DataFrame:
    """The accumulating loop: counters and sums of truncated line values by supplier."""
    x = _lines(spark, d).withColumn("net", numeric.stored(F.col("price") * (1 - F.col("disc")), "S9(13)V99"))
    by = x.groupBy("l_suppkey").agg(F.count("*").alias("items"), F.sum("qty").alias("q"), F.sum("net").alias("a"), F.max("l_shipdate").alias("last_shipment"))
    out = records.lookup(by, read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "inner")
    return out.select("s_suppkey", "s_name", "items", kept("q", 25).alias("quantity"), kept("a", 28).alias("amount"), "last_shipment")


@query(f"select count(*) suppliers, cast(sum(n) as bigint) items, cast(sum(q) as decimal(25,2)) quantity from (select l_suppkey, count(*) n, sum({_Q}) q from lineitem group by 1)")
def supplier_grand_total(spark: SparkSession, d: str) -> DataFrame:
    by = _lines(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("qty").alias("q"))
    return by.agg(F.count("*").alias("suppliers"), F.sum("n").alias("items"), F.sum("q").cast("decimal(25,2)").alias("quantity"))


@query(f"select l_returnflag, cast(sum({_TRUNC}) as decimal(28,2)) amount from lineitem group by 1")
def compute_truncate(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).withColumn("net", numeric.stored(F.col("price") * (1 - F.col("disc")), "S9(13)V99"))
    return x.groupBy("l_returnflag").agg(F.sum("net").cast("decimal(28,2)").alias("amount"))


@query(f"select l_returnflag, cast(sum(round({_P} * (1 - {_D}), 2)) as decimal(28,2)) amount from lineitem group by 1")
def compute_rounded(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).withColumn("net", numeric.stored(F.col("price") * (1 - F.col("disc")), "S9(13)V99", rounded=True))
    return x.groupBy("l_returnflag").agg(F.sum("net").cast("decimal(28,2)").alias("amount"))


@query("select o_orderkey, cast(case when cast(o_totalprice as decimal(15,2)) + 50000 >= 100000 then 0 else cast(o_totalprice as decimal(15,2)) + 50000 end as decimal(7,2)) total, cast(o_totalprice as decimal(15,2)) + 50000 >= 100000 size_error from orders")
def add_size_error(spark: SparkSession, d: str) -> DataFrame:
    x, pic = money("o_totalprice") + 50000, "S9(5)V99"
    old = F.lit(0).cast("decimal(7,2)")
    return read(spark, d, "orders").select("o_orderkey", numeric.stored(x, pic, old).alias("total"), numeric.size_error(x, pic).alias("size_error"))


@query(f"select l_orderkey, l_linenumber, cast({_P} * 100 as bigint) // cast({_Q} * 100 as bigint) quotient, cast({_P} - ({_Q} * (cast({_P} * 100 as bigint) // cast({_Q} * 100 as bigint))) as decimal(15,2)) remainder from lineitem")
def divide_giving_remainder(spark: SparkSession, d: str) -> DataFrame:
    q, r = numeric.divided(F.col("price"), F.col("qty"), "S9(13)")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", q.cast("long").alias("quotient"), r.cast("decimal(15,2)").alias("remainder"))


@query("select p_partkey, cast(cast(p_retailprice as decimal(15,2)) % 100 as decimal(4,2)) price from part")
def move_numeric_truncation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", numeric.moved(money("p_retailprice"), "9(2)V99").alias("price"))


@query("select c_custkey, rpad(c_name, 25, ' ') wide, substr(c_mktsegment, 1, 4) narrow from customer")
def move_alnum_pad(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", strings.padded(F.col("c_name"), 25).alias("wide"), strings.padded(F.col("c_mktsegment"), 4).alias("narrow"))


@query("select c_name as name, c_nationkey nationkey, cast(c_acctbal as decimal(15,2)) acctbal from customer")
def move_corresponding(spark: SparkSession, d: str) -> DataFrame:
    source = read(spark, d, "customer").selectExpr("c_custkey custkey", "c_name name", "c_nationkey nationkey", "cast(c_acctbal as decimal(15,2)) acctbal")
    return records.corresponding(source, source.columns, ["suppkey", "name", "nationkey", "acctbal"])


@query("select o_orderpriority, count(*) n, count(*) filter (where o_orderstatus in ('F', 'P')) closing, count(*) filter (where cast(o_totalprice as decimal(15,2)) between 100000 and 200000) middle from orders group by 1")
def level88_flags(spark: SparkSession, d: str) -> DataFrame:
    status = Field("STATUS", picture("X(2)"), conditions=(("CLOSING", ("F", "P")),))
    price = Field("PRICE", picture("S9(13)V99"), conditions=(("MIDDLE", (("100000", "200000"),)),))
    flags = {"closing": conditions.level88(status, "CLOSING", F.col("o_orderstatus")), "middle": conditions.level88(price, "MIDDLE", money("o_totalprice"))}
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in flags.items()))


@query("select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'RUSH' when o_orderpriority between '3' and '4' then 'NORMAL' else 'LATER' end class, count(*) n from orders group by 1")
def evaluate_priority(spark: SparkSession, d: str) -> DataFrame:
    c = conditions.evaluate(F.col("o_orderpriority"), (["1-URGENT", "2-HIGH"], "RUSH"), (("3", "4"), "NORMAL"), other="LATER")
    return read(spark, d, "orders").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("select regexp_full_match(substr(p_brand, 7), '[0-9.+-]*') as is_number, regexp_full_match(p_name, '[A-Za-z ]*') is_alphabetic, count(*) n from part group by 1, 2")
def class_conditions(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "part")
    number, letters = conditions.is_numeric(F.expr("substr(p_brand, 7)")), conditions.is_alphabetic(F.col("p_name"))
    return x.groupBy(number.alias("is_number"), letters.alias("is_alphabetic")).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey, cast(o_totalprice as decimal(15,2)) price, row_number() over (partition by o_custkey order by cast(o_totalprice as decimal(15,2)) desc, o_orderkey) place from orders order by o_custkey, price desc, o_orderkey")
def sort_multi_key(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    x = read(spark, d, "orders").select("o_orderkey", "o_custkey", money("o_totalprice").alias("price"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("price"), "o_orderkey"))
    return records.sort(x.withColumn("place", place), "o_custkey", ("price", "desc"), "o_orderkey")


@query("select o_orderkey k, 'order' kind from orders union all select l_orderkey, 'line' from lineitem")
def merge_sorted_files(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind"))
    b = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind"))
    return records.merge(a, b, keys=["k"])


@query(f"select l_returnflag, l_linestatus, 2 - cast(grouping(l_returnflag) + grouping(l_linestatus) as integer) break_level, count(*) n, cast(sum({_Q}) as decimal(25,2)) quantity from lineitem group by rollup(l_returnflag, l_linestatus)")
def control_break_report(spark: SparkSession, d: str) -> DataFrame:
    out = records.control_break(_lines(spark, d), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.sum("qty"))
    return out.select("l_returnflag", "l_linestatus", F.col("break_level").cast("int").alias("break_level"), "n", kept("quantity", 25).alias("quantity"))


@query("select o_custkey, o_orderkey, cast(sum(cast(o_totalprice as decimal(15,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as decimal(25,2)) balance from orders")
def running_balance(spark: SparkSession, d: str) -> DataFrame:
    out = records.running(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], balance=money("o_totalprice"))
    return out.select("o_custkey", "o_orderkey", kept("balance", 25).alias("balance"))


@query("select s_suppkey, n_name, r_name from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def search_all_lookup(spark: SparkSession, d: str) -> DataFrame:
    x = records.lookup(read(spark, d, "supplier"), read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return records.lookup(x, read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("select case when p_size <= 10 then 1 when p_size <= 20 then 2 when p_size <= 35 then 3 end band, count(*) n from part group by 1")
def search_linear_range(spark: SparkSession, d: str) -> DataFrame:
    limits = F.array(F.lit(10), F.lit(20), F.lit(35))
    band = records.search(limits, lambda x: F.col("p_size") <= x)
    return read(spark, d, "part").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("select c_custkey, c_name from customer where c_custkey = 7")
def indexed_read_by_key(spark: SparkSession, d: str) -> DataFrame:
    return records.read_key(read(spark, d, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where c_custkey >= 100")
def start_browse(spark: SparkSession, d: str) -> DataFrame:
    return records.start(read(spark, d, "customer"), "c_custkey", "NOT LESS", 100).select("c_custkey", "c_name")


@query("select c_custkey, coalesce(n, 0) orders, cast(c_acctbal as decimal(15,2)) acctbal from customer left join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey")
def indexed_rewrite_merge(spark: SparkSession, d: str) -> DataFrame:
    store = read(spark, d, "customer").select("c_custkey", F.lit(0).cast("long").alias("orders"), money("c_acctbal").alias("acctbal"))
    changed = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return records.rewrite(store, changed, "c_custkey")


@query("select coalesce(k1, k2) k, case when k1 is not null and k2 is not null then 'both' when k1 is not null then 'master' else 'transaction' end matched, n from (select c_custkey k1 from customer) full join (select o_custkey k2, count(*) n from orders group by 1) on k1 = k2")
def matched_merge_customers_orders(spark: SparkSession, d: str) -> DataFrame:
    totals = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return records.matched_merge(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), totals, "k").select("k", "matched", "n")


@query("select c_custkey, rpad(split_part(c_name, '#', 1) || '/' || c_mktsegment, 20, ' ') as target, length(split_part(c_name, '#', 1) || '/' || c_mktsegment) > 20 overflow from customer")
def string_concat(spark: SparkSession, d: str) -> DataFrame:
    out, _, over = strings.string(F.lit(""), 20, (F.col("c_name"), "#"), (F.lit("/"), None), (F.col("c_mktsegment"), None))
    return read(spark, d, "customer").select("c_custkey", out.alias("target"), over.alias("overflow"))


@query("select c_custkey, split_part(c_name, '#', 1) a, split_part(c_name, '#', 2) b from customer")
def unstring_split(spark: SparkSession, d: str) -> DataFrame:
    got, _, _ = strings.unstring(F.col("c_name"), 2, "#")
    return read(spark, d, "customer").select("c_custkey", got[0].alias("a"), got[1].alias("b"))


@query("select conv_id, turn, (length(text) - length(replace(text, 'e', '')))::integer es, length(text)::integer n from conversations")
def inspect_tally(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", strings.tally(t, "ALL", "e").alias("es"), strings.tally(t, "CHARACTERS").alias("n"))


@query("select conv_id, turn, replace(text, 'a', '*') as everywhere, case when strpos(text, ' ') > 0 then substr(text, 1, strpos(text, ' ') - 1) || '_' || substr(text, strpos(text, ' ') + 1) else text end first_blank from conversations")
def inspect_replace(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", strings.replaced(t, "ALL", "a", "*").alias("everywhere"), strings.replaced(t, "FIRST", " ", "_").alias("first_blank"))


@query("select c_custkey, translate(c_mktsegment, 'AEIOU', 'aeiou') segment from customer")
def inspect_converting(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", strings.converted(F.col("c_mktsegment"), "AEIOU", "aeiou").alias("segment"))


@query("select c_custkey, substr(c_name, 10, 9) digits, substr(c_name, 1, 3) || 'XX' || substr(c_name, 6) marked from customer")
def refmod(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    return read(spark, d, "customer").select("c_custkey", strings.part(n, 10, 9).alias("digits"), strings.overlaid(n, F.lit("XX"), 4, 2).alias("marked"))


@query("""select event_id, coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) as decimal(12,2)), 0) k, cast(value as decimal(15,2)) amount from events""")
def numval_parse(spark: SparkSession, d: str) -> DataFrame:
    k = intrinsics.call("NUMVAL", F.regexp_extract("props", "([0-9]+)", 1)).cast("decimal(12,2)")
    amount = intrinsics.call("NUMVAL-C", F.concat(F.lit("$ "), money("value").cast("string")))
    return read(spark, d, "events").select("event_id", k.alias("k"), amount.cast("decimal(15,2)").alias("amount"))


@query("select c_custkey, ((c_custkey - 50) % 7 + 7) % 7 as modulo, (c_custkey - 50) % 7 as remainder, cast(floor(cast(c_acctbal as decimal(15,2))) as bigint) whole, cast(trunc(cast(c_acctbal as decimal(15,2))) as bigint) part from customer")
def intrinsic_numeric(spark: SparkSession, d: str) -> DataFrame:
    k, b = F.col("c_custkey") - 50, money("c_acctbal")
    c = {"modulo": ("MOD", k, F.lit(7)), "remainder": ("REM", k, F.lit(7)), "whole": ("INTEGER", b), "part": ("INTEGER-PART", b)}
    return read(spark, d, "customer").select("c_custkey", *(intrinsics.call(*v).cast("long").alias(n) for n, v in c.items()))


@query(f"select l_orderkey, l_linenumber, greatest({_P}, {_Q}, {_D}) largest, least({_P}, {_Q}, {_D}) smallest, {_P} + {_Q} + {_D} - greatest({_P}, {_Q}, {_D}) - least({_P}, {_Q}, {_D}) as middle from lineitem")
def intrinsic_stats(spark: SparkSession, d: str) -> DataFrame:
    xs = (F.col("price"), F.col("qty"), F.col("disc"))
    c = {"largest": "MAX", "smallest": "MIN", "middle": "MEDIAN"}
    return _lines(spark, d).select("l_orderkey", "l_linenumber", *(intrinsics.call(f, *xs).cast("decimal(15,2)").alias(n) for n, f in c.items()))


SQL["intrinsic_stats"] = f"select l_orderkey, l_linenumber, cast(largest as decimal(15,2)) largest, cast(smallest as decimal(15,2)) smallest, cast(middle as decimal(15,2)) middle from ({SQL['intrinsic_stats']})"


@query("select p_partkey, ascii(p_type) + 1 code, upper(p_name) as up, reverse(p_name) as back, length(p_name)::integer as n from part")
def ord_char(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", intrinsics.call("ORD", F.col("p_type")).alias("code"), intrinsics.call("UPPER-CASE", n).alias("up"), intrinsics.call("REVERSE", n).alias("back"), intrinsics.call("LENGTH", n).alias("n"))


@query("select o_orderkey, lpad('$' || ltrim(format('{:,.2f}', cast(o_totalprice as decimal(15,2)))), 14, ' ') shown from orders")
def edited_amounts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", edited.edited(money("o_totalprice"), "$$$,$$$,$$9.99").alias("shown"))


def _account(usage: str, sign: str = "TRAILING") -> Layout:
    return Layout.of("ACCOUNT", Field("KEY", picture("9(9)"), BINARY), Field("NAME", picture("X(25)")), Field("BALANCE", picture("S9(9)V99"), usage, sign))


def _roundtrip(spark: SparkSession, d: str, layout: Layout, encoding: str | None = None) -> DataFrame:
    x = read(spark, d, "customer").select(F.col("c_custkey").cast("decimal(9,0)").alias("KEY"), F.col("c_name").alias("NAME"), (money("c_acctbal") - 5000).alias("BALANCE"))
    back = codec.records(codec.to_records(x, layout, encoding=encoding), layout, encoding=encoding)
    return back.select(F.col("KEY").cast("long").alias("custkey"), F.rtrim("NAME").alias("name"), F.col("BALANCE").cast("decimal(15,2)").alias("balance"))


_BACK = "select c_custkey custkey, c_name as name, cast(cast(c_acctbal as decimal(15,2)) - 5000 as decimal(15,2)) balance from customer"


@query(_BACK)
def comp3_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, _account(PACKED))


@query(_BACK)
def display_overpunch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, _account("DISPLAY"))


@query(_BACK)
def ebcdic_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, _account("DISPLAY", "LEADING SEPARATE"), "cp037")


@query(f"select l_orderkey, cast(sum({_Q}) as decimal(25,2)) total, count(*)::integer items from lineitem group by 1")
def occurs_table_totals(spark: SparkSession, d: str) -> DataFrame:
    table = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_list("qty").alias("t"))
    total = F.aggregate("t", F.lit(0).cast("decimal(25,2)"), lambda a, x: (a + x).cast("decimal(25,2)"))
    return table.select("l_orderkey", total.alias("total"), F.size("t").alias("items"))


@query("select o_orderkey, year(o_orderdate)::integer y, month(o_orderdate)::integer m, day(o_orderdate)::integer d from orders")
def redefines_date_parts(spark: SparkSession, d: str) -> DataFrame:
    layout = Layout.from_copybook("01 R. 05 DT PIC X(8). 05 PARTS REDEFINES DT. 10 Y PIC 9(4). 10 M PIC 9(2). 10 D PIC 9(2).")
    data = read(spark, d, "orders").select("o_orderkey", codec.to_bytes(F.date_format("o_orderdate", "yyyyMMdd")).alias("value"))
    parts = codec._value(F.col("value"), layout.field("PARTS"), None, 0)
    return data.select("o_orderkey", *(parts[n].cast("int").alias(n.lower()) for n in ("Y", "M", "D")))


@query("select c_custkey custkey, c_name as name, cast(c_acctbal as decimal(15,2)) balance from customer")
def json_generate_parse(spark: SparkSession, d: str) -> DataFrame:
    layout = Layout.of("C", Field("custkey", picture("9(9)")), Field("name", picture("X(25)")), Field("balance", picture("S9(13)V99")))
    x = read(spark, d, "customer").selectExpr("c_custkey custkey", "c_name name", "cast(c_acctbal as decimal(15,2)) balance")
    return files.from_json(files.to_json(x), layout).withColumn("custkey", F.col("custkey").cast("long"))


@query("select c_custkey custkey, c_name as name, cast(c_acctbal as decimal(15,2)) balance from customer")
def xml_generate_parse(spark: SparkSession, d: str) -> DataFrame:
    layout = Layout.of("C", Field("custkey", picture("9(9)")), Field("name", picture("X(25)")), Field("balance", picture("S9(13)V99")))
    x = read(spark, d, "customer").selectExpr("c_custkey custkey", "c_name name", "cast(c_acctbal as decimal(15,2)) balance")
    return files.from_xml(files.to_xml(x, "customer"), layout, "customer").withColumn("custkey", F.col("custkey").cast("long"))


@query("select c_custkey, c_name from customer where c_custkey = 5")
def sql_select_into(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "customer").createOrReplaceTempView("sql_customer")
    got = Session(spark).select_into("select c_custkey, c_name into :WS-KEY, :WS-NAME from sql_customer where c_custkey = :WS-WANTED", ws_wanted=5)
    return spark.createDataFrame([got.value] if got.code == 0 else [], "c_custkey long, c_name string")


@query("select c_nationkey, cast(sum(cast(c_acctbal as decimal(15,2))) as decimal(25,2)) total from customer where c_mktsegment = 'BUILDING' group by 1")
def sql_cursor_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """A cursor whose rows are added up: its rows as one frame."""
    read(spark, d, "customer").createOrReplaceTempView("sql_customer")
    s = Session(spark)
    s.declare("BUILDERS", "select c_nationkey, cast(c_acctbal as decimal(15,2)) b from sql_customer where c_mktsegment = :SEGMENT")
    return s.rows("BUILDERS", segment="BUILDING  ").groupBy("c_nationkey").agg(F.sum("b").cast("decimal(25,2)").alias("total"))


@query("select s_suppkey, cast(case when s_nationkey < 5 then cast(s_acctbal as decimal(15,2)) + 100 else cast(s_acctbal as decimal(15,2)) end as decimal(15,2)) balance from supplier where s_nationkey <> 9")
def sql_dml_update_delete(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", money("s_acctbal").alias("balance"))
    x.createOrReplaceTempView("sql_supplier")
    with Session(spark) as s:
        s.update("sql_supplier", "s_nationkey < 5", balance="balance + 100")
        s.delete("sql_supplier", "s_nationkey = 9")
    return spark.table("sql_supplier").select("s_suppkey", "balance")


@query("select event_type, min(event_id) event_id from events group by 1")
def dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return records.first_seen(read(spark, d, "events"), "event_type", "event_id")


@query(f"select l_orderkey, l_linenumber, {_Q} > 40 or {_D} > 0.08 rejected from lineitem")
def validate_reject_split(spark: SparkSession, d: str) -> DataFrame:
    return records.checked(_lines(spark, d), (F.col("qty") <= 40) & (F.col("disc") <= 0.08)).select("l_orderkey", "l_linenumber", "rejected")
