"""Builders of numbers against Python's decimal."""

import random
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import edited, intrinsics, numeric, strings
from ledgerframe.picture import BINARY, PACKED, Field, Layout, picture
from ledgerframe.sources import codec


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    xs = [Decimal(rng.randint(-(10**9), 10**9)).scaleb(-rng.choice([0, 1, 3, 5])) for _ in range(200)] + [Decimal("0"), Decimal("-0.005"), Decimal("2.125"), Decimal("-2.125")]
    return spark.createDataFrame([(x,) for x in xs], "x decimal(18,5)").cache()


@pytest.mark.parametrize("pic", ["S9(5)V99", "9(3)", "S9(2)V9(4)"])
@pytest.mark.parametrize("rounded", [False, True])
def test_stored_and_moved(numbers, pic, rounded):
    p = picture(pic)
    for r in numbers.select("x", numeric.stored(F.col("x"), pic, rounded=rounded).alias("s"), numeric.size_error(F.col("x"), pic, rounded).alias("e"), numeric.moved(F.col("x"), pic).alias("m")).collect():
        q = r.x.quantize(Decimal(1).scaleb(-p.decimals), ROUND_HALF_UP if rounded else ROUND_DOWN)
        error = abs(q) >= 10**p.whole
        assert r.e == error
        assert r.s == (None if error else q if p.signed else abs(q))
        m = r.x.quantize(Decimal(1).scaleb(-p.decimals), ROUND_DOWN)
        m = abs(m) % 10**p.whole * (-1 if m < 0 and p.signed else 1)
        assert r.m == m


@pytest.mark.parametrize(
    "pic, x, shown",
    [
        ("$$,$$$,$$9.99", "15000", "   $15,000.00"),
        ("$$,$$$,$$9.99", "5", "        $5.00"),
        ("$999.99", "123.45", "$123.45"),
        ("ZZ,ZZ9.99", "1234.5", " 1,234.50"),
        ("ZZ,ZZ9.99", "0.05", "     0.05"),
        ("**,***,**9.99", "1234.56", "*****1,234.56"),
        ("---9.9", "-12.34", " -12.3"),
        ("+999", "7", "+007"),
        ("999CR", "-7", "007CR"),
        ("99/99/9999", "12312024", "12/31/2024"),
    ],
)
def test_edited(spark, pic, x, shown):
    got = spark.range(1).select(edited.edited(F.lit(x).cast("decimal(15,4)"), pic).alias("e")).first().e
    assert got == shown
    back = spark.range(1).select(edited.plain(F.lit(shown), pic).alias("b")).first().b
    if "/" not in pic:
        assert abs(back) == abs(Decimal(x)).quantize(Decimal(1).scaleb(-picture(pic).decimals), ROUND_DOWN)


@pytest.mark.parametrize("usage, sign", [("DISPLAY", "TRAILING"), ("DISPLAY", "LEADING"), ("DISPLAY", "LEADING SEPARATE"), ("DISPLAY", "TRAILING SEPARATE"), (PACKED, "TRAILING"), (BINARY, "TRAILING")])
@pytest.mark.parametrize("encoding", [None, "cp037", "cp500", "cp1047"])
def test_codecs_give_back(numbers, usage, sign, encoding):
    layout = Layout.of("R", Field("A", picture("X(4)")), Field("N", picture("S9(7)V99"), usage, sign), Field("FILLER", picture("X(2)")), Field("T", picture("9(3)"), occurs=3))
    x = numbers.where("abs(x) < 9999999").select(F.lit("ab{").alias("A"), numeric.moved(F.col("x"), "S9(7)V99").alias("N"), F.array(F.lit(1), F.lit(22), F.lit(333)).cast("array<decimal(3,0)>").alias("T"))
    data = codec.to_records(x, layout, encoding=encoding)
    assert data.where(F.octet_length("value") != layout.size).count() == 0
    back = codec.records(data, layout, encoding=encoding).withColumn("A", F.rtrim("A"))
    assert sorted(map(str, back.collect())) == sorted(map(str, x.select(back.columns).collect()))


def test_packed_bytes(spark):
    x = spark.sql("select cast(-123.45 as decimal(5,2)) N")
    layout = Layout.of("R", Field("N", picture("S999V99"), PACKED))
    assert codec.to_records(x, layout).first().value.hex() == "12345d"


def test_copybook():
    layout = Layout.from_copybook(
        """
       01  CUST-REC.
           05  CUST-ID        PIC 9(5) COMP.
           05  CUST-NAME.
               10  FIRST-N    PIC X(10).
               10  LAST-N     PIC X(10).
           05  KIND           PIC X.
               88  GOOD       VALUE 'A' 'B'.
               88  RANGE-1    VALUE 'C' THRU 'F'.
           05  AMOUNTS        PIC S9(5)V99 COMP-3 OCCURS 3 TIMES.
           05  RAW-AMOUNTS REDEFINES AMOUNTS PIC X(12).
        """
    )
    assert [(f.name, f.offset, f.size) for f in layout.fields] == [("CUST_ID", 0, 4), ("CUST_NAME", 4, 20), ("KIND", 24, 1), ("AMOUNTS", 25, 12), ("RAW_AMOUNTS", 25, 12)]
    assert layout.field("KIND").conditions == (("GOOD", ("A", "B")), ("RANGE_1", (("C", "F"),)))
    assert layout.size == 37


def test_strings(spark):
    one = spark.range(1)
    s, p, o = strings.string(F.lit("..........."), 11, (F.lit("ab cd"), " "), (F.lit("xyz"), None), pointer=3)
    assert tuple(one.select(s, p, o).first()) == ("..abxyz....", 8, False)
    f, d, o = strings.unstring(F.lit("a,b;;c"), 3, ",", ";", all_=True)
    assert tuple(one.select(f, d, o).first()) == (["a", "b", "c"], [",", ";;"], False)
    x = F.lit("aabacada")
    assert tuple(one.select(strings.tally(x, "LEADING", "a"), strings.tally(x, "ALL", "a", after="c"), strings.replaced(x, "LEADING", "a", "x"), strings.converted(x, "abca", "1239", before="d")).first()) == (2, 2, "xxbacada", "112131da")
    assert one.select(intrinsics.call("NUMVAL", F.lit(" 12.5- "))).first()[0] == Decimal("-12.5")
    assert one.select(intrinsics.call("MOD", F.lit(-7), F.lit(3))).first()[0] == 2
