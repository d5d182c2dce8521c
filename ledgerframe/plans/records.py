"""Queries over files, stores, keys and orders: what a verb leaves in a file is read back, with record numbers where order counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions, moves, numeric
from ..operators import records
from ..picture import PACKED, Field, Layout, picture
from ..sources import codec, files, folders, registry, store
from ..sources.jdbc import embedded
from .catalog import kept, money, query, read

CUSTOMER = Layout.of("CUSTOMER", Field("K", picture("9(9)")), Field("NAME", picture("X(25)")), Field("BALANCE", picture("S9(9)V99"), PACKED))
ORDER = Layout.of("ORDERS", Field("K", picture("9(12)")), Field("CUSTOMER", picture("9(9)")), Field("PRICE", picture("S9(11)V99")))
KEYED = Layout.of("KEYED", Field("K", picture("9(12)")), Field("KIND", picture("X(5)")))
_CUSTOMERS = "select c_custkey k, c_name as name, cast(c_acctbal as decimal(11,2)) balance from customer"
_PRICE = "cast(o_totalprice as decimal(13,2))"


def place(spark: SparkSession) -> str:
    return f"{folders.shared(spark)}/query-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").cast("decimal(9,0)").alias("K"), F.col("c_name").alias("NAME"), F.col("c_acctbal").cast("decimal(11,2)").alias("BALANCE"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("decimal(12,0)").alias("K"), F.col("o_custkey").cast("decimal(9,0)").alias("CUSTOMER"), F.col("o_totalprice").cast("decimal(13,2)").alias("PRICE"))


def _back(df: DataFrame) -> DataFrame:
    return df.select(F.col("K").cast("long").alias("k"), F.rtrim("NAME").alias("name"), F.col("BALANCE").alias("balance"))


@query(_CUSTOMERS)
def sequential_file(spark: SparkSession, d: str) -> DataFrame:
    """OPEN OUTPUT, WRITE, CLOSE, OPEN INPUT, READ of fixed records; the hooks count what is opened and closed."""
    at, seen = place(spark), []
    f = files.RecordFile(spark, at, CUSTOMER, on_open=lambda f: seen.append(f.mode), on_close=lambda f: seen.append("closed"))
    for mode in ("OUTPUT", "INPUT"):
        if f.open(mode) != "00":
            raise OSError(f.status)
        out = f.write(_customers(spark, d)) if mode == "OUTPUT" else f.read()
        f.close()
    if seen != ["OUTPUT", "closed", "INPUT", "closed"]:
        raise OSError(f"hooks: {seen}")
    return _back(out)


@query(_CUSTOMERS)
def file_extend(spark: SparkSession, d: str) -> DataFrame:
    at, x = place(spark), _customers(spark, d)
    files.write_fixed(x.where("K < 100"), at, CUSTOMER)
    files.write_fixed(x.where("K >= 100"), at, CUSTOMER, mode="append")
    return _back(files.read_fixed(spark, at, CUSTOMER))


@query(_CUSTOMERS)
def varying_file(spark: SparkSession, d: str) -> DataFrame:
    at = place(spark)
    files.write_variable(_customers(spark, d), at, CUSTOMER, "cp037")
    return _back(files.read_variable(spark, at, CUSTOMER, "cp037"))


@query(_CUSTOMERS)
def line_sequential_file(spark: SparkSession, d: str) -> DataFrame:
    at, shown = place(spark), Layout.of("C", Field("K", picture("9(9)")), Field("NAME", picture("X(25)")), Field("BALANCE", picture("S9(9)V99"), sign="LEADING SEPARATE"))
    files.write_lines(_customers(spark, d), at, shown)
    return _back(files.read_lines(spark, at, shown))


@query(f"select c_custkey k, c_name as name, cast(cast(c_acctbal as decimal(11,2)) + case when c_custkey % 3 = 0 then 1 else 0 end as decimal(11,2)) balance from customer")
def sequential_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """OPEN I-O, READ and REWRITE of some records in place."""
    f = files.RecordFile(spark, place(spark), CUSTOMER)
    f.open("OUTPUT")
    f.write(_customers(spark, d))
    f.close()
    f.open("I-O")
    f.write(f.read().withColumn("BALANCE", F.when(F.col("K") % 3 == 0, F.col("BALANCE") + 1).otherwise(F.col("BALANCE"))))
    f.close()
    f.open("INPUT")
    return _back(f.read())


@query("select o_orderkey k, row_number() over (order by o_orderkey) place from orders")
def relative_records(spark: SparkSession, d: str) -> DataFrame:
    """Relative record numbers of a file that was written in the order of its key."""
    at = place(spark)
    files.write_fixed(_orders(spark, d).orderBy("K"), at, ORDER)
    return files.read_relative(spark, at, ORDER).select(F.col("K").cast("long").alias("k"), F.col("rrn").alias("place"))


@query(f"select o_orderkey k, row_number() over (order by o_custkey, {_PRICE} desc, o_orderkey) place from orders")
def sort_file_order(spark: SparkSession, d: str) -> DataFrame:
    """SORT USING GIVING: each record's place in the sorted file."""
    at = place(spark)
    files.write_fixed(_orders(spark, d).orderBy("K"), f"{at}/in", ORDER)
    files.sort_file(spark, [f"{at}/in"], f"{at}/out", ORDER, "CUSTOMER", ("PRICE", "desc"))
    return files.read_relative(spark, f"{at}/out", ORDER).select(F.col("K").cast("long").alias("k"), F.col("rrn").alias("place"))


@query("select k, kind, row_number() over (order by k, f, n) place from (select o_orderkey k, 'order' kind, 0 f, 0 n from orders union all select l_orderkey, 'line', 1, row_number() over (order by l_orderkey, l_linenumber) from lineitem)")
def merge_file_order(spark: SparkSession, d: str) -> DataFrame:
    """MERGE of two files, one with repeated keys: each record's place in the merged file."""
    at = place(spark)
    one = lambda df, k, kind: df.select(F.col(k).cast("decimal(12,0)").alias("K"), F.lit(kind).alias("KIND"))
    files.write_fixed(one(read(spark, d, "orders").orderBy("o_orderkey"), "o_orderkey", "order"), f"{at}/a", KEYED)
    files.write_fixed(one(read(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber"), "l_orderkey", "line"), f"{at}/b", KEYED)
    files.sort_file(spark, [f"{at}/a", f"{at}/b"], f"{at}/out", KEYED, "K")
    return files.read_relative(spark, f"{at}/out", KEYED).select(F.col("K").cast("long").alias("k"), F.rtrim("KIND").alias("kind"), F.col("rrn").alias("place"))


@query("select o_orderkey k, row_number() over (order by o_orderkey) place from orders where o_orderkey >= 100")
def start_browse_order(spark: SparkSession, d: str) -> DataFrame:
    """START NOT LESS, then READ NEXT to the end: each record's place in what is read."""
    at = place(spark)
    files.write_fixed(records.start(_orders(spark, d), "K", "NOT LESS", 100), at, ORDER)
    return files.read_relative(spark, at, ORDER).select(F.col("K").cast("long").alias("k"), F.col("rrn").alias("place"))


@query("select line, count(*) n from (select n_name line from nation union all select '' from nation union all select '' from nation) group by 1")
def advancing_lines(spark: SparkSession, d: str) -> DataFrame:
    """WRITE AFTER ADVANCING 3 LINES: two empty lines before each."""
    return files.advanced(read(spark, d, "nation").select(F.col("n_name").alias("line")), "line", 3).groupBy("line").agg(F.count("*").alias("n"))


@query("""select c_custkey, translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij') < translate(b, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij') as ebcdic_less, a < b as ascii_less
from (select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else substr(c_name, 10) end a, case when c_custkey % 3 = 0 then c_mktsegment else substr(c_name, 10) || 'X' end b from customer)""")
def ebcdic_collation(spark: SparkSession, d: str) -> DataFrame:
    """Letters come before digits in EBCDIC, after them in ASCII."""
    digits = F.expr("substr(c_name, 10)")
    a = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(digits)
    b = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(digits, F.lit("X")))
    less = lambda e: conditions.compare_text(a, b, "<", e)
    return read(spark, d, "customer").select("c_custkey", less("cp037").alias("ebcdic_less"), less(None).alias("ascii_less"))


@query("select p_partkey, p_name || '[x]^!' as a, p_name || '[x]^!' as b from part")
def ebcdic_code_pages(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("p_name", F.lit("[x]^!"))
    back = lambda page: codec.to_text(codec.to_bytes(t, page), page)
    return read(spark, d, "part").select("p_partkey", back("cp500").alias("a"), back("cp1047").alias("b"))


@query(_CUSTOMERS)
def codec_registry(spark: SparkSession, d: str) -> DataFrame:
    """Record codecs by name, one after the other."""
    x = _customers(spark, d)
    for name in ("ebcdic", "json", "xml", "fixed"):
        x = registry.decode(name, registry.encode(name, x, CUSTOMER), CUSTOMER)
    return _back(x)


@query("select s_suppkey, s_name as name, cast(s_acctbal as decimal(11,2)) balance from supplier where s_nationkey < 10")
def jdbc_table(spark: SparkSession, d: str) -> DataFrame:
    """A table of a database, written and read with a condition and columns pushed down."""
    x = read(spark, d, "supplier").select(F.col("s_suppkey").alias("K"), F.col("s_name").alias("NAME"), F.col("s_acctbal").cast("decimal(11,2)").alias("BALANCE"), F.col("s_nationkey").alias("NATION"))
    c = embedded(x, "SUPPLIER", place(spark))
    return c.table("SUPPLIER").where("NATION < 10").select(F.col("K").alias("s_suppkey"), F.col("NAME").alias("name"), F.col("BALANCE").alias("balance"))


def _store(spark: SparkSession, d: str) -> store.RecordStore:
    s = store.RecordStore(spark, place(spark), CUSTOMER, "K", indexes=("NAME",))
    s.insert(_customers(spark, d).where("K < 1000"))
    return s


@query("""select c_custkey k, case when c_custkey between 10 and 19 then 'changed' when c_custkey between 995 and 1004 then 'merged' else c_name end as name, cast(c_acctbal as decimal(11,2)) balance from customer where c_custkey < 1005 and c_custkey % 100 <> 50""")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """Insert, update, upsert and delete by key; inserts of keys that are there are rejects."""
    s, x = _store(spark, d), _customers(spark, d)
    rejects = s.insert(x.where("K < 20"))
    s.update(x.where("K between 10 and 19").withColumn("NAME", F.lit("changed")))
    s.upsert(x.where("K between 995 and 1004").withColumn("NAME", F.lit("merged")))
    s.delete(x.where("K % 100 = 50"))
    if rejects.count() != x.where("K < 20").count():
        raise ValueError("rejects")
    return _back(s.find_all())


@query("select count(*) n, count(*) filter (where c_name like '%1') as ones from customer where c_custkey < 1000")
def store_count_and_find(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    ones = s.find_where("rtrim(NAME) like :mask", mask="%1")
    return spark.range(1).select(F.lit(s.count()).cast("long").alias("n")).crossJoin(ones.agg(F.count("*").alias("ones")))


@query("select c_custkey k, c_name as name, 7 as grade from customer where c_custkey < 1000")
def store_migration(spark: SparkSession, d: str) -> DataFrame:
    """A store brought up to a layout with one more field and one less."""
    s = _store(spark, d)
    wider = store.RecordStore(spark, s.path, Layout.of("CUSTOMER", *CUSTOMER.fields[:2], Field("GRADE", picture("9(2)"))), "K")
    if not wider.migrate(lambda df: df.withColumn("GRADE", F.lit(7).cast("decimal(2,0)"))) or wider.migrate():
        raise ValueError("versions")
    return wider.find_all().select(F.col("K").cast("long").alias("k"), F.rtrim("NAME").alias("name"), F.col("GRADE").cast("int").alias("grade"))


@query("select c_custkey, cast(substr(c_name, 10) as decimal(9,0)) number, cast(0 as decimal(5,0)) bad from customer")
def move_text_to_number(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c, p: numeric.moved(numeric.numeric_text(c), p)
    return read(spark, d, "customer").select("c_custkey", number(F.concat(F.lit("  "), F.expr("substr(c_name, 10)")), "9(9)").alias("number"), number(F.col("c_mktsegment"), "S9(5)").alias("bad"))


@query("""select s_suppkey, cast(case when abs(a + 9000) >= 10000 then a else a + 9000 end as decimal(6,2)) added, cast(a - 500 as decimal(6,2)) less from (select s_suppkey, cast(cast(s_acctbal as decimal(15,2)) % 5000 as decimal(6,2)) a from supplier)""")
def corresponding_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """ADD and SUBTRACT CORRESPONDING: the fields that both groups have; what doesn't fit stays."""
    layout = Layout.of("G", Field("A", picture("S9(4)V99")), Field("T", picture("X(3)")))
    a = (money("s_acctbal") % 5000).cast("decimal(6,2)")
    x = read(spark, d, "supplier").select("s_suppkey", a.alias("A"), F.lit("x").alias("T"), F.lit(9000).cast("decimal(6,2)").alias("up_A"), F.lit(500).cast("decimal(6,2)").alias("down_A"))
    up, down = moves.corresponding(x, layout, layout, "ADD", "up_"), moves.corresponding(x, layout, layout, "SUBTRACT", "down_")
    return up.select("s_suppkey", F.col("A").alias("added")).join(down.select("s_suppkey", F.col("A").alias("less")), "s_suppkey")


@query("select o_orderkey, o_custkey as later, null::bigint as beyond, 5::bigint as changed from orders")
def table_elements(spark: SparkSession, d: str) -> DataFrame:
    """F(i), and MOVE TO F(i)."""
    t = F.array("o_orderkey", "o_custkey")
    return read(spark, d, "orders").select("o_orderkey", moves.element(t, 2).alias("later"), moves.element(t, 3).alias("beyond"), moves.element(moves.set_element(t, 1, F.lit(5).cast("long")), 1).alias("changed"))


@query("select n_nationkey, '   ' as spaces, cast(0 as decimal(3,0)) number, 3 as cells, 'YES' as flag, repeat(chr(255), 2) as high from nation")
def initial_values(spark: SparkSession, d: str) -> DataFrame:
    """INITIALIZE, SET TO TRUE and figurative constants."""
    layout = Layout.from_copybook("01 R.\n 05 A PIC X(3). 88 GOOD VALUE 'YES' 'OK'.\n 05 N PIC S9(3). 05 T PIC 9(2) OCCURS 3. 05 H PIC X(2).")
    x = moves.initialized(read(spark, d, "nation"), layout)
    return x.select("n_nationkey", F.col("A").alias("spaces"), F.col("N").alias("number"), F.size("T").alias("cells"), moves.set_true(layout.field("A"), "GOOD").alias("flag"), moves.filled("HIGH-VALUES", layout.field("H")).alias("high"))


@query("select o_orderpriority, count(*) filter (where cast(o_totalprice as decimal(15,2)) % 2 < 1) as evens, count(*) filter (where o_orderstatus || '  ' <> o_orderstatus) as padded, count(*) filter (where cast(o_totalprice as decimal(15,2)) - 150000 < 0) negative from orders group by 1")
def condition_functions(spark: SparkSession, d: str) -> DataFrame:
    """A condition that is a function, text that is equal but for blanks, and a sign test."""
    price = conditions.with_condition(Field("PRICE", picture("S9(13)V99")), "EVEN", lambda x: x % 2 < 1)
    even = conditions.level88(price, "EVEN", money("o_totalprice"))
    alike = conditions.equal_text(F.concat("o_orderstatus", F.lit("  ")), F.col("o_orderstatus"))
    below = conditions.is_negative(money("o_totalprice") - 150000)
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(even).alias("evens"), F.count_if(alike).alias("padded"), F.count_if(below).alias("negative"))


@query("select o_orderkey, cast(case when cast(o_totalprice as decimal(15,2)) >= 100000 then 99999.99 else cast(o_totalprice as decimal(15,2)) end as decimal(7,2)) total from orders")
def size_error_function(spark: SparkSession, d: str) -> DataFrame:
    """What a field holds after a size error is a function of the result."""
    most = F.lit("99999.99").cast("decimal(7,2)")
    return read(spark, d, "orders").select("o_orderkey", numeric.stored(money("o_totalprice"), "S9(5)V99", on_error=lambda x: most).alias("total"))


@query("select s_suppkey, case when s_nationkey < 5 then 1 else 0 end as changes, case when s_nationkey < 5 then cast(s_nationkey + 100 as varchar) end as now from supplier")
def tracked_changes(spark: SparkSession, d: str) -> DataFrame:
    """What statements changed in each record, as a column."""
    x = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    x = numeric.tracked(x, s_nationkey=F.when(F.col("s_nationkey") < 5, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")), s_name=F.col("s_name"))
    return x.select("s_suppkey", F.size("changes").alias("changes"), F.get("changes", F.lit(0))["new"].alias("now"))


@query("select o_custkey, count(*) n, max(o_orderkey) as newest from orders where o_orderstatus <> 'P' group by 1")
def sort_procedures(spark: SparkSession, d: str) -> DataFrame:
    """SORT with an INPUT PROCEDURE that releases some records and an OUTPUT PROCEDURE that returns totals."""
    def put(df: DataFrame) -> DataFrame:
        return df.where("o_orderstatus <> 'P'")

    def get(df: DataFrame) -> DataFrame:
        return df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))

    return records.sort(read(spark, d, "orders"), "o_custkey", ("o_orderkey", "desc"), input_procedure=put, output_procedure=get, in_order=True)


@query(f"select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by {'cast(l_quantity as decimal(15,2))'} desc, l_linenumber) as lines from lineitem group by 1")
def sort_table_of_record(spark: SparkSession, d: str) -> DataFrame:
    """SORT of a table in the record: by quantity, largest first, equal ones in order."""
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", money("l_quantity").alias("q")))).alias("t"))
    by = records.sort_table(F.col("t"), ("q", "desc"))
    return t.select("l_orderkey", F.array_join(F.transform(by, lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


@query(f"select o_orderkey, {_PRICE} as price from orders order by price desc, o_orderkey limit 100")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(13,2)").alias("price"))
    return records.top(x, 100, ("price", "desc"), "o_orderkey")


@query("select o_orderkey, case when p < 0 then null else p // 1000 * 1000 end as low, case when p < 0 then null else 'band ' || cast(p // 1000 as varchar) end as name from (select o_orderkey, cast(trunc(o_totalprice) as bigint) p from orders)")
def search_range_join(spark: SparkSession, d: str) -> DataFrame:
    """SEARCH in a large table of ranges, as a join by cells."""
    bands = spark.range(1000).select((F.col("id") * 1000).alias("low"), (F.col("id") * 1000 + 999).alias("high"), F.concat(F.lit("band "), F.col("id").cast("string")).alias("name"))
    x = read(spark, d, "orders").select("o_orderkey", numeric.truncated(money("o_totalprice"), 0).cast("long").alias("p"))
    return records.search_range(x, bands, "p", "low", "high", 5000).select("o_orderkey", "low", "name")


@query(f"select c_custkey, n, cast(total as decimal(25,2)) total from customer left join (select o_custkey, count(*) n, sum({_PRICE}) total from orders group by 1) on o_custkey = c_custkey")
def call_by_key(spark: SparkSession, d: str) -> DataFrame:
    """CALL of a query program for each customer, as one plan."""
    orders = read(spark, d, "orders")

    def program(keys: DataFrame) -> DataFrame:
        mine = orders.join(keys, orders["o_custkey"] == keys["c_custkey"])
        return mine.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(13,2)")).cast("decimal(25,2)").alias("total"))

    return records.call_by_key(read(spark, d, "customer").select("c_custkey"), "c_custkey", program)


@query(f"select o_orderkey, lag(o_orderkey) over w as before, max({_PRICE}) over (w rows unbounded preceding) as highest from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def previous_record(spark: SparkSession, d: str) -> DataFrame:
    """A loop that keeps the record before and the highest price so far, by customer."""
    x, order = read(spark, d, "orders"), ["o_orderdate", "o_orderkey"]
    x = records.previous(x, ["o_custkey"], order, before=F.col("o_orderkey"))
    x = records.running(x, ["o_custkey"], order, F.max, highest=F.col("o_totalprice").cast("decimal(13,2)"))
    return x.select("o_orderkey", "before", "highest")


@query("select k, v from (select n_nationkey k, n_regionkey v from nation union all select 100 + r_regionkey, r_regionkey from region)")
def keyed_write_rejects(spark: SparkSession, d: str) -> DataFrame:
    """WRITE to a keyed file of new records, some twice and some whose keys are there: status 22 for all but the first."""
    old = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    new = read(spark, d, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_regionkey").alias("v"))
    new = new.withColumn("seq", F.lit(1)).union(new.selectExpr("k", "v + 50", "2")).union(old.selectExpr("k", "v + 60", "3"))
    after, rejects = records.write_keyed(old.withColumn("seq", F.lit(0)), new, "k", "seq")
    if rejects.count() != read(spark, d, "region").count() + old.count():
        raise ValueError("rejects")
    return after.select("k", "v")


@query("select n_nationkey k, case when n_nationkey < 5 then 'last' else n_name end as name from nation where n_nationkey <> 7")
def keyed_rewrite_delete(spark: SparkSession, d: str) -> DataFrame:
    """REWRITE with two changes to one key, and of a key that isn't there; DELETE."""
    old = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    changed = old.where("k < 5 ").select("k", F.lit("first").alias("name"), F.lit(1).alias("seq")).union(old.where("k < 5").select("k", F.lit("last"), F.lit(2))).union(spark.sql("select 999, 'none', 3"))
    return records.delete(records.rewrite(old, changed, "k", "seq"), spark.sql("select 7 as k"), "k")
