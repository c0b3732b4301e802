"""Scalar functions on the cases that define them."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corvata.functions import dates, fields, geometry, money, text


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


MONEY = {
    "₹ 1,23,456.75": "123456.75", "(1,000.00)": "-1000", "500 CR": "-500", "1O0.5O": "100.50", "12 DR.": "12", "Rs. 7": "7", "INR5": "5", "-3.25": "-3.25", "+4": "4",
    "26/06/2026": None, "IP/12345": None, "999999999999999999": None, "1.": None, "": None, None: None, "abc": None, "a@1": None, "10:30": None, "1.23456": None, "()": None, "(": None,
}


def test_money(spark):
    want = [None if v is None else Decimal(v) for v in MONEY.values()]
    assert values(spark, list(MONEY), money.parse_decimal) == want


def test_quantity(spark):
    assert values(spark, ["1.", "3 days", "2 Day(s).", "1,000 days", "x", None], money.parse_quantity) == [1, 3, 2, 1000, None, None]


def test_amounts_and_rounding(spark):
    got = spark.sql("select cast(2.345 as decimal(18,4)) x").select(money.half_even(F.col("x")), money.half_up(F.col("x"))).first()
    assert tuple(got) == (Decimal("2.34"), Decimal("2.35"))
    df = spark.sql("select * from values (1.00bd, 1.01bd), (1.00bd, 1.02bd), (null, 1.00bd) t(a, b)")
    assert [r[0] for r in df.select(money.amount_matches(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert values(spark, ["2 x 50.00 = 100.00", "7", ""], lambda c: F.size(money.numeric_parts(c, 2))) == [3, 0, 0]


DATES = {
    "12-Feb-2026": date(2026, 2, 12), "12/02/2026": date(2026, 2, 12), "12 February 2026": date(2026, 2, 12), "2026-02-12 10:24:02": date(2026, 2, 12), "20/01/202610:24:02": date(2026, 1, 20),
    "01/02/75": date(1975, 2, 1), "01/02/68": date(2068, 2, 1), " - 01.02.2020": date(2020, 2, 1), "1/2/2020, 1:05 pm": date(2020, 2, 1),
    "20/01/2026 99:99:99": None, "20/01/2026 - 21/01/2026": None, "31/02/2026": None, "on 1/2/2020": None, "1/2-2020": None, "1/2/2020 13:05 pm": None, "": None, None: None,
}


def test_dates(spark):
    assert values(spark, list(DATES), dates.parse_service_date) == list(DATES.values())


def test_texts(spark):
    assert values(spark, ["[x] Straße 5mg!", None, "--"], text.match_text) == ["strasse 5mg", "", ""]
    assert values(spark, ["Net  Amount (₹)", "", None], text.header_key) == ["net_amount", None, None]
    assert values(spark, ["IP/12-3", "-"], text.code_key) == ["ip123", None]
    assert values(spark, ["ＮＥＴ Amount"], text.compatible_header) == ["net amount"]
    df = spark.createDataFrame([("abc", "abc"), ("abcd", "bc"), ("", "x"), ("abcd", "abxd")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(text.text_score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.45, 0.0, 0.75]
    got = spark.sql("select array('a','b') x, array('b','c') y, array() z").select(text.jaccard(F.col("x"), F.col("y")), text.jaccard(F.col("x"), F.col("z"))).first()
    assert (round(got[0], 3), got[1]) == (0.333, None)


def test_fields(spark):
    ok = [("service_code", "AB12", True), ("service_code", "1234", False), ("hsn_code", "9983", True), ("hsn_code", "12/02/2026", False), ("section", "Ward", True), ("section", "12.50", False), ("description", "x" * 501, False), ("other", "x", False)]
    df = spark.createDataFrame(ok, "f string, v string, w boolean")
    assert all(r[0] == r[1] for r in df.select(fields.is_valid(F.col("f"), F.col("v")), "w").collect())
    assert values(spark, ["=1+1", " @x", "safe", "-5", None], fields.safe_cell) == ["'=1+1", "' @x", "safe", "'-5", None]
    assert values(spark, ["bill_h00012a.pdf"], fields.hospital_id) == ["H00012A"]
    assert values(spark, ["x.pdf"], fields.hospital_id)[0].startswith("UNKNOWN-")
    assert values(spark, ["call 12345678 or a.b@c.org"], fields.redact) == ["call [id] or [email]"]
    share = spark.range(10_000).select(fields.sampled(F.col("id").cast("string"), F.lit("p"), 5).cast("int")).agg(F.sum(F.col(spark.range(1).select(fields.sampled(F.col("id").cast("string"), F.lit("p"), 5).cast("int")).columns[0]))).first()[0]
    assert 400 <= share <= 600


def test_geometry(spark):
    box = lambda l, t, r, b: f"named_struct('l', {l}d, 't', {t}d, 'r', {r}d, 'b', {b}d)"
    df = spark.sql(f"select {box(0, 0, 2, 2)} a, {box(1, 1, 3, 3)} b, {box(5, 5, 5, 5)} c, array(named_struct('x', 0d, 'y', 0d), named_struct('x', 4d, 'y', 0d), named_struct('x', 4d, 'y', 3d)) p, array(1d, 0d, 5d, 0d, 1d, 7d, 0d, 0d, 1d) h")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(geometry.iou(a, b), geometry.iou(a, c), geometry.centre_in(a, b), geometry.shoelace(F.col("p")), geometry.bounds(F.col("p")), geometry.centre_proximity(a, a, F.lit(3.0), F.lit(4.0))).first()
    assert (round(got[0], 6), got[1], got[2], got[3], tuple(got[4]), got[5]) == (round(1 / 7, 6), 0.0, True, 6.0, (0.0, 0.0, 4.0, 3.0), 1.0)
    moved = df.select(geometry.project(F.col("h"), F.lit(1.0), F.lit(2.0)), geometry.compose(F.col("h"), geometry.invert("h"))).first()
    assert tuple(moved[0]) == (6.0, 9.0) and [round(x, 9) for x in moved[1]] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


@pytest.mark.parametrize("x,y", [(0.0, 0.0), (999.5, 3.25), (1e3, 1e3)])
def test_round_trip(spark, x, y):
    df = spark.sql("select array(0d, -2d, 40d, 2d, 0d, -7d, 0d, 0d, 1d) h").withColumn("p", geometry.project(F.col("h"), F.lit(x), F.lit(y)))
    back = df.select(geometry.project(geometry.invert("h"), F.col("p.x"), F.col("p.y")).alias("b")).first().b
    assert abs(back.x - x) < 1e-8 and abs(back.y - y) < 1e-8


def test_polygons_under_perspective_have_no_chord_far_off(spark):
    import math

    from corvata.functions.geometry import inverse, round_trip_error, subdivided

    h = [1.0, 0.1, 5.0, 0.05, 1.0, 2.0, 4e-4, 0.0, 1.0]
    ring = [(0.0, 0.0), (900.0, 0.0), (900.0, 600.0), (0.0, 600.0)]

    def image(x, y):
        w = h[6] * x + h[7] * y + h[8]
        return ((h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w)

    want = []
    for i, (ax, ay) in enumerate(ring):
        bx, by = ring[(i + 1) % 4]
        for d in range(13):
            n = 1 << d
            at = lambda t, a=(ax, ay), b=(bx, by): image(a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
            off = max(math.dist(at((k + 0.5) / n), tuple((p + q) / 2 for p, q in zip(at(k / n), at((k + 1) / n), strict=True))) for k in range(n))
            if off <= 0.5:
                want += [at((k + 1) / n) for k in range(n)]
                break
    df = spark.createDataFrame([(h, [dict(x=x, y=y) for x, y in ring])], "h array<double>, p array<struct<x:double,y:double>>")
    got = df.select(subdivided(F.col("h"), F.col("p"), 0.5).alias("s"), round_trip_error(F.col("h"), F.col("p")).alias("e"), inverse(F.array(*[F.lit(1.0)] * 9)).alias("none")).first()
    assert len(got.s) == len(want) > 8 and all(math.dist((a.x, a.y), b) < 1e-6 for a, b in zip(got.s, want, strict=True))
    assert got.e < 1e-6 and got.none is None


def test_a_polygon_is_made_once_whatever_its_number_of_points(spark):
    """The part of a plan that makes the polygon stands in the area once; it took a second for a dozen rows where each point made it anew."""
    made = F.transform(F.sequence(F.lit(0), F.col("id").cast("int") * 0 + 7), lambda i: F.struct(F.cos(i * 3.141592653589793 / 4).alias("x"), F.sin(i * 3.141592653589793 / 4).alias("y")))
    df = spark.range(1).select(geometry.shoelace(made).alias("a"), geometry.shoelace(F.lit(None).cast("array<struct<x:double,y:double>>")).alias("none"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("cos(") == 1
    got = df.first()
    assert abs(got.a - 8**0.5) < 1e-9 and got.none == 0.0


def test_polygons_query_makes_each_ring_once(spark):
    from corvata.plans.queries_core import polygons_to_source

    plan = polygons_to_source(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate([1,2,4,") == 1
