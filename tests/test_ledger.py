"""Ledger, totals, layout, review and source operators on constructed cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from corvata.operators import alignment, classify, graph, layout, recovery, review, selection, totals
from corvata.operators import ledger as L
from corvata.plans import authority, corpus, metrics, profiles, rules
from corvata.sources import otsl, readers


def states(spark, rows, printed):
    r = spark.createDataFrame(rows, "document_id long, role string, cents long")
    p = spark.createDataFrame(printed, "document_id long, total_cents long")
    return {x.document_id: x.comparison for x in L.reconcile(r, p).collect()}


def test_reconciliation_states(spark):
    rows = [(1, "detail", 100), (1, "refund", -50), (2, "detail", 100), (3, "detail", None), (4, "detail", 5), (5, "detail", 7), (6, "category_rollup", 900), (6, "category_rollup", 40), (7, "metadata", 1), (8, "detail", 101)]
    printed = [(1, 50), (2, 500), (3, 5), (5, 7), (5, 8), (6, 900), (7, 0), (8, 100)]
    assert states(spark, rows, printed) == {1: "match", 2: "mismatch", 3: "items_partial", 4: "bill_total_missing", 5: "multiple_printed_totals", 6: "match", 7: "match", 8: "match"}


def test_policy_keeps_look_alikes(spark):
    s = "document_id long, row_id string, row_order int, role string, section string, description string, cents long"
    rows = [
        (1, "a", 0, "detail", "Lab", "Blood count", 100), (1, "b", 1, "category_rollup", "Lab", "Lab total", 100), (1, "c", 2, "category_rollup", "Ward", "Ward", 0), (1, "d", 3, "category_rollup", "Room", "Room rent", 100),
        (1, "e", 4, "category_rollup", None, "Blood count!", 100), (1, "f", 5, "category_rollup", None, "Blood", 100), (2, "g", 0, "category_rollup", "Lab", "Lab total", 100), (1, "h", 6, "category_rollup", "X", "Y", None), (1, "i", 7, None, None, None, None),
    ]
    got = L.charge_policy(spark.createDataFrame(rows, s)).orderBy("document_id", "row_order").collect()
    assert [(r.row_id, r.row_order) for r in got] == [("a", 0), ("d", 1), ("f", 2), ("h", 3), ("i", 4), ("g", 0)]


def test_receipts_flag_the_first_of_two(spark):
    s = "document_id long, row_id string, page int, is_receipt boolean, issuer string, reference string, cents long, service_date string, description string"
    rows = [(1, "a", 1, True, "lab", "r1", 5, "d", "x"), (1, "b", 2, True, "lab", "r1", 6, "d", "y"), (1, "c", 1, False, "lab", "", 5, "d", "x"), (1, "d", 9, False, "lab", "", 5, "d", "x"), (1, "e", 1, True, "", "r1", 5, "d", "x")]
    got = {(r.left_id, r.right_id): (r.flagged, r.basis) for r in L.receipt_duplicates(spark.createDataFrame(rows, s)).collect()}
    assert got == {("a", "b"): ("a", "exact_reference"), ("a", "c"): ("a", "dated_grounded_charge")}


def test_totals_need_one_final_context(spark):
    def run(lines):
        df = spark.createDataFrame([(d, 1, i, t, c, 0.9, i * 20.0) for d, i, t, c in lines], "document_id long, page int, line int, text string, cents long, confidence double, top double")
        found = totals.candidates(df)
        found = found.withColumn("context_kind", totals.context_kind(F.lit("item_ledger"), F.col("local_text"), F.col("scope"))).withColumn("context_id", F.concat_ws(":", "page", "context_kind", F.when(F.col("document_id") == 2, F.col("line")).otherwise(1)))
        return {r.document_id: (r.label, r.cents) for r in totals.primary(totals.distinct_totals(found)).collect()}

    got = run([(1, 0, "Sub Total 900.00", 90000), (1, 1, "Net Bill Amount", None), (1, 2, "₹ 1,000.50", 100050), (2, 0, "Grand Total", 1), (2, 1, "Total Bill Amount", 2), (3, 0, "Total Amount", 5), (4, 0, "Discount on net bill amount", 5)])
    assert got == {1: ("Net Bill Amount", 100050)}


def test_markup(spark):
    t = "Service Name<fcel>Qty/Days<fcel>Amount<fcel>Total Amount<nl><fcel>Registration<fcel>1.00<ecel><fcel>100.00<nl><fcel>Sub Total<lcel><lcel><fcel>100.00"
    df = spark.createDataFrame([(1, t), (2, "no tags"), (3, None)], "document_id long, content string")
    cells = otsl.cells(df)
    assert cells.where("document_id <> 1").count() == 0 and cells.count() == 12 and cells.where("is_span").count() == 2
    roles = {r.role: r.column for r in otsl.columns(cells, ["document_id"]).collect()}
    assert roles == {"description": 0, "quantity": 1, "amount": 3, "rate": 2}
    rows = otsl.candidate_rows(cells, ["document_id"]).orderBy("row").collect()
    assert [(r.description, r.quantity, r.amount) for r in rows] == [("Registration", 1, 100), ("Sub Total", None, 100)]
    collapsed = spark.createDataFrame([(1, "<fcel>Item<fcel>Rate<fcel>Qty<fcel>Amount<nl><fcel>Ondet 2ML<fcel>12.70<fcel>2<ecel>")], "document_id long, content string")
    r = otsl.candidate_rows(otsl.cells(collapsed), ["document_id"]).first()
    assert (r.amount, r.amount_derived) == (Decimal("25.4000"), True)
    two = spark.createDataFrame([(1, "<fcel>Item<fcel>Rate<nl><fcel>a<fcel>1<nl><fcel>Service<fcel>Amount<nl><fcel>b<fcel>2")], "document_id long, content string")
    assert [r.part for r in otsl.split_tables(otsl.cells(two), ["document_id"]).select("row", "part").distinct().orderBy("row").collect()] == [0, 0, 1, 1]


def test_running_groups_and_boxes():
    assert layout.running_groups([0, 4, 8, 30, 33], 6) == [0, 0, 0, 1, 1]
    assert layout.running_groups([], 6) == []
    assert layout.merge_boxes([(0, 0, 10, 10), (5, 0, 15, 10), (50, 50, 60, 60)]) == [(0, 0, 15, 10), (50, 50, 60, 60)]


def test_graph(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 9), (7, 8), (8, 7)], "child long, parent long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "node long")
    assert {(r.child, r.ancestor, r.depth) for r in graph.closure(edges).where("child < 5").collect()} == {(2, 1, 1), (3, 2, 1), (3, 1, 2)}
    assert {(r.node, r.fault) for r in graph.graph_faults(nodes, edges).collect()} == {(5, "missing_parent"), (7, "cycle"), (8, "cycle")}
    assert {r.node: r.root for r in graph.roots(nodes, edges).where("node < 5").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    c = graph.components(nodes, spark.createDataFrame([(1, 5), (5, 7), (3, 4)], "a long, b long"))
    assert {r.node: r.component for r in c.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1, 6: 6, 7: 1, 8: 8}


def test_unique_mapping():
    one = [[(1,), None], [None, (1,)]]
    assert recovery.unique_mapping(one) == [0, 1]
    assert recovery.unique_mapping([[(1,), (1,)]]) is None  # two ways
    assert recovery.unique_mapping([[None, None]]) is None
    assert recovery.unique_mapping([[(1,), (2,)]]) == [1]


def test_fusion_and_grounding():
    from collections import namedtuple

    R = namedtuple("R", "text cents")
    ours = [R("consultatlon", 100), R("xray", 50)]
    assert alignment.fuse(ours, [R("consultation", 100), R("x ray chest", 50)]) == [(0, 0), (1, 1)]
    assert alignment.fuse(ours, []) == [(0, None), (1, None)]
    T = namedtuple("T", "token_id text cents y left right height")
    tokens = [T("a", "needle", None, 10.0, 0.0, 50.0, 10.0), T("b", "5 00", 500, 11.0, 80.0, 99.0, 10.0), T("c", "needle", None, 40.0, 0.0, 50.0, 10.0), T("d", "5 00", 500, 41.0, 80.0, 99.0, 10.0)]
    assert alignment.ground([R("needle", 500), R("needle", 500)], tokens) == [(0, "a", "b"), (1, "c", "d")]


def test_selection_abstains(spark):
    box = lambda x: (x, 0.0, x + 100.0, 100.0)
    rows = [(1, 1, "r1", "raw", 0, box(0.0)), (1, 1, "r2", "raw", 0, box(500.0)), (1, 1, "b1", "bright", 1, box(2.0)), (1, 1, "b2", "bright", 1, box(900.0)), (1, 1, "s1", "straight", 2, box(905.0)), (2, 1, "r", "raw", 0, box(0.0)), (2, 1, "q1", "bright", 1, box(1.0)), (2, 1, "q2", "bright", 1, box(2.0))]
    df = spark.createDataFrame([(d, p, i, v, n, b, 1, "t", ["w"], 1000.0, 2000.0, False) for d, p, i, v, n, b in rows], "document_id long, page int, proposal_id string, variant string, preference int, box struct<l:double,t:double,r:double,b:double>, reading_order int, table_type string, words array<string>, page_width double, page_height double, grounded boolean")
    edges = selection.proposal_edges(df, "raw")
    got = {(r.anchor_id, r.candidate_id): r.reason for r in edges.collect()}
    assert got["r1", "b1"] == "accepted_maximum_weight" and got["r", "q1"] == got["r", "q2"] == "abstained_ambiguous" and got["r2", "b1"].startswith("rejected")
    derived = selection.derived_tables(df, edges, "raw").collect()
    assert [(r.document_id, r.members, r.variants) for r in derived] == [(1, 2, 2)]


def test_gates_and_floors(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert v(metrics.precision(lit(0), lit(0), lit(0))) == 1.0 and v(metrics.precision(lit(0), lit(0), lit(3))) == 0.0 and v(metrics.recall(lit(0), lit(0))) == 1.0
    ok = {"all_rows": 0.95, "all_amount": 0.99, "all_negative": 1.0, "ungrounded": 0, "privacy": 0, "unseen_hospitals": 10, "unseen_rows": 0.9, "known_documents": 10, "known_gold": 200, "known_rows": 0.97, "known_amount": 0.99, "known_negative": 1.0, "bound": 0.9, "active": 10, "zero_calls": 1.0}
    fail = lambda **k: v(metrics.cohort_failures({n: lit(x) for n, x in (ok | k).items()}))
    assert fail() == [] and fail(bound=0.85) == ["aggregate_confidence_lower_bound_not_above_85_percent"]
    assert fail(unseen_hospitals=9, known_gold=199, active=0) == ["unseen_10_hospital_gate_missing", "known_active_profile_gate_missing", "active_zero_call_fraction_below_95_percent"]
    r = spark.createDataFrame([("a", 95, 100), ("b", 0, 0)], "measure string, numerator long, denominator long")
    assert {x.measure: (x.ratio, x.passed) for x in metrics.floors(r, {"a": 0.95, "b": 0.5}).collect()} == {"a": (0.95, True), "b": (1.0, False)}
    g = spark.createDataFrame([(1, "amount", str(i)) for i in range(20)], "k long, field string, value string").withColumn("k", F.monotonically_increasing_id())
    p = g.withColumn("value", F.when(F.col("value") == "0", "x").otherwise(F.col("value")))
    m = metrics.field_metrics(g, p, ["k"], []).first()
    assert m.accuracy == 0.95 and not m.passed  # the threshold is strict


def test_unreadable_cells_may_pass_one(spark):
    s = "document_id long, table_id string, row_key int, column_key int, role string, value string, readable boolean"
    g = spark.createDataFrame([(1, "t", 0, 0, "amount", None, False), (1, "t", 0, 1, "text", "a", True)], s)
    counts = authority.cell_counts(authority.cell_outcomes(g, g), ["document_id"])
    ratios = authority.with_ratios(counts)
    assert ratios.first().precision == 2.0 and authority.over_one(ratios, ["precision", "recall"]).count() == 1
    swapped = spark.createDataFrame([(1, "t", 0, 0, "amount", "a", True), (1, "t", 0, 1, "text", "b", True)], s)
    gold = spark.createDataFrame([(1, "t", 0, 0, "amount", "b", True), (1, "t", 0, 1, "text", "a", True)], s)
    assert {r.outcome for r in authority.cell_outcomes(gold, swapped).collect()} == {"wrong_column"}


def test_profiles(spark):
    e = spark.createDataFrame([("p", 1, "candidate", "shadow"), ("p", 2, "archived", "active")], "profile_key string, version int, from_state string, to_state string")
    assert {r.version: r.allowed for r in profiles.transitions(e).collect()} == {1: True, 2: False}
    p = spark.createDataFrame([("p", 3, "active", False), ("p", 2, "archived", True), ("p", 1, "archived", True), ("q", 1, "active", True)], "profile_key string, version int, lifecycle string, passed boolean")
    assert [(r.archive_version, r.activate_version) for r in profiles.rollback(p).collect()] == [(3, 2)]


def test_profile_lookup_finds_its_own(spark):
    import bench

    got = {r.observation_id: r.profile_key for r in bench.profile_lookup(spark, 500, 20).collect()}
    assert got == {f"o-{i}": f"profile-{i * 199 % 500}" for i in range(20)}


def test_issues_and_targets(spark):
    s = "document_id long, code string, severity string, page int, table_id string, row_id string"
    i = spark.createDataFrame([(1, "x", "blocking", 1, None, None), (1, "y", "blocking", 1, "t", "r"), (1, "z", "blocking", 2, "t", "r"), (2, "w", "warning", 1, None, None), (1, "x", "blocking", 1, None, None)], s)
    assert rules.report(i).count() == 4
    d = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    assert {r.document_id: r.status for r in rules.status(d, rules.report(i)).collect()} == {1: "needs_review", 2: "passed", 3: "passed"}
    assert {(r.page, r.table_id) for r in rules.recovery_targets(i).collect()} == {(1, None), (2, "t")}


def test_splits_and_search(spark):
    g = spark.createDataFrame([(f"g{i}",) for i in range(10)], "g string")
    n = {r.split: r["count"] for r in corpus.grouped_splits(g, "g", "s").groupBy("split").count().collect()}
    assert n == {"train": 6, "validation": 2, "holdout": 2}
    df = spark.createDataFrame([("100% cotton",), ("a_b",), (None,)], "x string")
    assert df.where(review.matches("0%", F.col("x"))).count() == 1 and df.where(review.matches("_", F.col("x"))).count() == 1


def test_table_types(spark):
    f = F.lit
    kind = lambda t, h="", rows=5, serial=False, header=False: spark.range(1).select(classify.table_type(f(t), f(h), f(rows), f(serial), f(header), f(False)).alias("k")).first().k
    assert [kind("UHID 1 IP No 2"), kind("UHID 1 IP No 2", header=True), kind("Package Break Up"), kind("MRP M.R.P Exp"), kind("Payer Received"), kind("x", "Test Name"), kind("Particulars", serial=True), kind("x")] == ["metadata", "item_ledger", "package_summary", "pharmacy", "payment", "laboratory", "category_summary", "item_ledger"]
    cat = lambda d, k="item_ledger": spark.range(1).select(classify.charge_category(f(d), f(k)).alias("k")).first().k
    assert [cat("Surgery package"), cat("x", "pharmacy"), cat("Room charges"), cat("OT charges"), cat("zzz")] == ["package", "pharmacy", "bed", "ot", None]


def test_sources(spark, tmp_path):
    (tmp_path / "H00012.json").write_text('{"bill_file": "b.pdf", "document_total": 75.00, "rows": [{"page_number": 1, "table_id": "t", "row_order": 0, "description": "Complete Blood Count", "amount": 50.00, "request_no": "REQ-1"}]}')
    (tmp_path / "copy.json").write_text((tmp_path / "H00012.json").read_text())
    r = readers.gold_rows(spark, str(tmp_path / "H00012.json")).first()
    assert (r.amount, r.description, r.input) == (50, "Complete Blood Count", 0)
    (tmp_path / "actual.txt").write_text('{"rows": [{"page": 2, "raw_text": "x", "net_amount": "5.5"}, {"page_number": 1, "description": "y", "amount": "bad"}]}')
    assert [(a.page, a.description, a.amount, a.row_order) for a in readers.loose_rows(spark, str(tmp_path / "actual.txt")).orderBy("input").collect()] == [(2, "x", Decimal("5.5000"), 0), (1, "y", None, 1)]
    files = readers.catalog(spark, str(tmp_path), "*.json")
    assert {f.hospital_id[:7] for f in files.collect()} == {"H00012", "UNKNOWN"} and readers.duplicates(files).first().files == 2
    pages = spark.createDataFrame([(1, 1, 10.0, 20.0, 2.0, ["a", " "], [0.9, 0.8], [[1.0, 2.0, 3.0, 4.0], [0.0] * 4])], "document_id long, page int, origin_x double, origin_y double, scale double, texts array<string>, scores array<double>, boxes array<array<double>>")
    t = readers.ocr_tokens(pages).collect()
    assert len(t) == 1 and tuple(t[0].box) == (12.0, 24.0, 16.0, 28.0)
    cache = spark.createDataFrame([("k1", "old")], "cache_key string, value string")
    whole, new = readers.cached(spark.createDataFrame([("k1",), ("k2",)], "cache_key string"), cache, lambda x: x.withColumn("value", F.lit("new")))
    assert {(r.cache_key, r.value) for r in whole.collect()} == {("k1", "old"), ("k2", "new")} and new.count() == 1
    readers.write_csv(spark.createDataFrame([("=1", -5)], "t string, n int"), str(tmp_path / "csv"), ["t", "n"], {"n"})
    assert "'=1,-5" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_hospital_names(spark):
    from corvata.operators import identity

    rows = [
        (1, 0, "NABH", 0.9, 0.0, 2.0), (1, 1, "CITY CARE", 0.9, 10.0, 15.0), (1, 2, "HOSPITAL AND RESEARCH INSTITUTE", 0.9, 60.0, 65.0), (1, 3, "Address: somewhere hospital road", 0.9, 90.0, 95.0),
        (2, 0, "Patient Name of the hospital", 0.9, 10.0, 15.0), (3, 0, "Sunrise Clinic Patient Name X", 0.8, 10.0, 15.0), (4, 0, "Low Hospital Center", 0.9, 900.0, 905.0),
    ]
    df = spark.createDataFrame([(*r, 2000.0) for r in rows], "document_id long, line int, text string, confidence double, top double, centre double, page_height double")
    got = {r.document_id: r.name for r in identity.hospitals(df).collect()}
    assert got == {1: "City Care Hospital and Research Institute", 3: "Sunrise Clinic"}


def test_sensitive_values_by_place(spark):
    from corvata.operators import identity

    rows = [("a", "Patient Name", 0.0, 0.0, 100.0), ("b", "Jo Doe", 150.0, 0.0, 80.0), ("c", "Total", 900.0, 0.0, 50.0), ("d", "under", 10.0, 15.0, 50.0), ("e", "far below", 10.0, 90.0, 50.0), ("f", "x@y.org", 500.0, 300.0, 50.0), ("g", "12345678", 500.0, 400.0, 50.0)]
    df = spark.createDataFrame([(1, 1, i, t, (l, y, l + w, y + 10.0), 1000.0) for i, t, l, y, w in rows], "document_id long, page int, token_id string, text string, box struct<l:double,t:double,r:double,b:double>, page_width double")
    assert {r.token_id for r in identity.sensitive_tokens(df).where("masked").collect()} == {"a", "b", "d", "f", "g"}


def test_service_dates_in_context(spark):
    from datetime import date

    from corvata.functions.dates import service_date_from_context

    cases = [
        ("12/02/2026", "Date", False, "Batch x", date(2026, 2, 12)), ("12/02/2026", "Expiry", False, "Syrup", None), ("12/02/2026", "Expiry", True, "Syrup", date(2026, 2, 12)), ("12/02/2026 IPD/123 CO", "Particulars", False, "Consultation", date(2026, 2, 12)),
        ("12/02/2026 IPD/123 XY", "Particulars", False, "Consultation", None), ("X-ray 12/02/2026", "Particulars", False, "X-ray", date(2026, 2, 12)), ("12/02/2026 to 13/02/2026", "Stay", False, "Room", None), (None, "Date", False, None, None), ("exp 12/02/2026", "x", False, "y", None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, l string, m boolean, d string, w date")
    got = df.select("i", "w", service_date_from_context(F.col("v"), F.col("l"), F.col("m"), F.col("d")).alias("g")).collect()
    assert [(r.i, r.g) for r in got if r.g != r.w] == []


def test_header_roles(spark):
    from corvata.operators import headers

    rows = [
        (1, "Sr No", 0.0), (1, "Particulars", 100.0), (1, "Batch Exp Date", 300.0), (1, "Qty", 500.0), (1, "MRP Amount", 600.0), (1, "Net Amount", 800.0),
        (2, "Total for services", 0.0), (2, "Amount", 500.0), (3, "Service Name", 0.0), (3, "HSN Code", 300.0), (3, "Charges", 500.0),
    ]
    df = spark.createDataFrame([(1, 1, n, f"{n}-{i}", t, (x, 0.0, x + 90.0, 10.0), "H1") for i, (n, t, x) in enumerate(rows)], "document_id long, page int, line int, token_id string, text string, box struct<l:double,t:double,r:double,b:double>, hospital_id string")
    got = {(r.line, r.role): r.token_id for r in headers.header_roles(df).collect()}
    assert got == {(1, "serial"): "1-0", (1, "description"): "1-1", (1, "batch"): "1-2", (1, "expiry"): "1-2", (1, "quantity"): "1-3", (1, "rate"): "1-4", (1, "amount"): "1-5"}
    alias = spark.createDataFrame([("H1", "charges", "amount")], "hospital_id string, label string, role string")
    more = {(r.line, r.role) for r in headers.header_roles(df, alias).collect()}
    assert {(3, "description"), (3, "hsn_code"), (3, "amount")} <= more and (3, "service_code") not in more
    assert headers.one_cell("sr no service name qty days rate total amount") == {"description": 1, "quantity": 2, "rate": 3, "amount": 4}
    assert headers.one_cell("date particulars") == {}


def test_bootstrap(spark):
    perfect = spark.createDataFrame([(i, 10, 10, 10) for i in range(30)], "document_id long, gold long, predicted long, matched long")
    assert {r.measure: r.bound for r in metrics.bootstrap(perfect, ["matched"], 200).collect()} == {"matched_precision": 1.0, "matched_recall": 1.0}
    half = perfect.withColumn("matched", F.when(F.col("document_id") % 2 == 0, 10).otherwise(6).cast("long"))
    bound = {r.measure: r.bound for r in metrics.bootstrap(half, ["matched"], 400).collect()}["matched_recall"]
    assert 0.68 < bound < 0.78  # 0.8 less two standard errors of 0.036
    assert {r.bound for r in metrics.bootstrap(perfect.limit(0), ["matched"], 50).collect()} == {0.0}


def test_reconstruction(spark):
    from corvata.operators.reconstruction import reconstruct

    lines = [
        ["Sr No@.05", "Particulars@.3", "Date@.5", "Qty@.6", "Rate@.75", "Net Amount@.95"], ["Ward charges@.3"], ["Registration@.3", "1@.6", "100.00@.75", "100.00@.95"], ["second visit@.3"], ["02/03/2026@.5"],
        ["Consultation@.3", "2@.6", "50.00@.75", "100.00@.95"], ["X-Ray@.3", "250.00@.75", "500.00@.95"], ["Refund of deposit@.3", "1@.6", "20.00@.75", "-20.00@.95"], ["Wrong@.3", "3@.6", "10.00@.75", "31.00@.95"],
        ["Sub Total@.3", "700.00@.95"], ["Gauze@.3"], ["10.00@.95"], ["7@.05", "5.00@.95"], ["Amount Received@.3", "1.00@.95"], ["After@.3", "9.00@.95"],
    ]
    tokens = [(1, 1, "t", n, f"{n}-{i}", *c.split("@"), n * 20.0, 18.0, "item_ledger") for n, line in enumerate(lines) for i, c in enumerate(line)]
    df = spark.createDataFrame([(a, b, c, d, e, t, float(x), y, h, k) for a, b, c, d, e, t, x, y, h, k in tokens], "document_id long, page int, table_id string, line int, token_id string, text string, x double, y double, height double, table_type string")
    got = [(r.description, r.section, r.service_date, r.quantity and r.quantity // 10000, r.amount // 100, r.role, r.flags) for r in reconstruct(df).orderBy("n").collect()]
    gaps = "missing_labeled_quantity,missing_labeled_unit_price"
    assert got == [
        ("Registration second visit", "Ward charges", None, 1, 10000, "detail", ""), ("Consultation", "Ward charges", "2026-03-02", 2, 10000, "detail", ""), ("X-Ray", "Ward charges", None, 2, 50000, "detail", "quantity_derived_from_rate_amount"),
        ("Refund of deposit", "Ward charges", None, 1, -2000, "refund", ""), ("Wrong", "Ward charges", None, 3, 3100, "detail", "line_arithmetic_mismatch"), ("Gauze", "Ward charges", None, None, 1000, "detail", gaps), ("7", "Ward charges", None, None, 500, "detail", f"missing_printed_description,{gaps}"),
    ]


def test_reconstruction_of_payment_headings_and_proven_quantities(spark):
    from corvata.operators.reconstruction import reconstruct

    head = ["Particulars@.3", "Qty@.6", "Rate@.75", "Net Amount@.95"]
    lines = [
        head, ["Ward rent@.3", "3 days@.6", "100.00@.75", "300.00@.95"], ["Oxygen@.3", "2.@.58", "50.00@.75", "100.00@.95"], ["Nursing@.3", "4 days@.6", "100.00@.75", "350.00@.95"], ["Both@.3", "2.@.58", "2 days@.62", "50.00@.75", "100.00@.95"],
        ["Waiting@.3"], ["7@.55", "Payment@.6", "Details@.65"], ["9.00@.95"], ["Gauze@.3"], ["Settlement history@.3"], ["5.00@.95"],
    ]
    tokens = [(1, 1, "t", n, f"{n}-{i}", t, float(x), n * 20.0, 18.0, "item_ledger") for n, line in enumerate(lines) for i, (t, x) in enumerate(c.split("@") for c in line)]
    df = spark.createDataFrame(tokens, "document_id long, page int, table_id string, line int, token_id string, text string, x double, y double, height double, table_type string")
    got = [(r.description, r.quantity and r.quantity / 10000, r.amount // 10000, r.flags) for r in reconstruct(df).orderBy("n").collect()]
    derived, gaps = "quantity_derived_from_rate_amount", "missing_labeled_quantity,missing_labeled_unit_price"
    assert got == [
        ("Ward rent", 3, 300, ""), ("Oxygen", 2, 100, ""), ("Nursing", None, 350, "missing_labeled_quantity"), ("Both", 2, 100, derived),
        ("", None, 9, f"missing_printed_description,{gaps}"), ("Gauze Settlement history", None, 5, gaps),
    ]


def codes(issues):
    return sorted((r.document_id, r.code) for r in issues.collect())


def test_inventory_and_token_rules(spark):
    make = spark.createDataFrame
    d = make([(1, 2), (2, 1)], "document_id long, page_count int")
    pages = make([(1, 1), (2, 1)], "document_id long, page int")
    tables = make([(1, 1, "t"), (1, 1, "t")], "document_id long, page int, table_id string")
    rows = make([(1, 1, "t", "r"), (1, 1, None, "r"), (1, 1, "t", "s")], "document_id long, page int, table_id string, row_id string")
    diag = make([(1, 1, None), (1, 1, "gone")], "document_id long, page int, table_id string")
    assert codes(rules.inventory_rules(d, pages, tables, rows, diag)) == sorted([
        (1, "page_inventory_incomplete"), (1, "page_count_mismatch"), (1, "duplicate_source_table_id"), (1, "duplicate_source_row_id"), (1, "source_row_anchor_missing"), (2, "source_tables_missing"), (2, "page_diagnostic_inventory_incomplete"),
        (1, "table_diagnostic_inventory_incomplete"), (1, "table_diagnostic_inventory_incomplete"), (1, "orphan_table_diagnostic"),
    ])
    box = "struct<l:double,t:double,r:double,b:double>"
    tokens = make([(1, 1, "a", "x", (0.0, 0.0, 5.0, 5.0)), (1, 1, "a", "y", (0.0, 0.0, 5.0, 5.0)), (1, 1, "b", " ", (0.0, 0.0, 5.0, 5.0)), (1, 1, "c", "z", (0.0, 0.0, 500.0, 5.0))], f"document_id long, page int, token_id string, text string, box {box}").withColumn("page_width", F.lit(100.0)).withColumn("page_height", F.lit(100.0))
    assert codes(rules.token_rules(tokens)) == [(1, "duplicate_token_manifest_id"), (1, "token_bounds_invalid"), (1, "token_manifest_entry_invalid")]


def test_total_link_usage_and_receipt_rules(spark):
    make = spark.createDataFrame
    s = "document_id long, cents long, label string, scope string, context_kind string, context_id string"
    found = make([(1, 5, "a", "document", "document_final", "c1"), (2, 5, "a", "document", "document_final", "c1"), (2, 6, "a", "document", "document_final", "c2"), (3, 5, "a", "document", "document_final", "c1"), (3, 5, "a", "payment", "document_final", "c1")], s)
    chosen = make([(3, 7, "a", "payment", "c1")], "document_id long, cents long, label string, scope string, context_id string")
    assert codes(rules.primary_total_rules(chosen, found)) == sorted([(1, "primary_total_missing_for_unique_context"), (2, "ambiguous_primary_total"), (3, "primary_total_not_in_candidates"), (3, "invalid_primary_total_scope"), (3, "inconsistent_document_total_context")])
    cells = make([(1, 1, "t", "r", "amount", "5"), (1, 1, "t", "r", "rate", "1")], "document_id long, page int, table_id string, row_id string, field string, value string")
    values = make([(1, "r", "amount", "6"), (1, "r", "date", "d")], "document_id long, row_id string, field string, value string")
    assert codes(rules.linked_value_rules(cells, values)) == [(1, "canonical_value_missing_printed"), (1, "mapped_cell_value_mismatch"), (1, "printed_value_missing_canonical")]
    usage = make([(1, 1, 1, 2, 0.1, 0.2, 0.3, 0), (2, 1, 1, 3, 0.0, 0.0, 0.0, 1)], "document_id long, initial_calls int, recovery_calls int, total_calls int, initial_cost double, recovery_cost double, total_cost double, hosted_recovery_calls int")
    assert codes(rules.usage_rules(usage)) == [(2, "provider_usage_aggregate_mismatch"), (2, "recovery_hosted_model_invoked")]
    pairs = make([(1, "a", "b", "a"), (1, "a", "x", "a")], "document_id long, left_id string, right_id string, flagged string")
    assert codes(rules.receipt_rules(pairs, make([(1, "a"), (1, "b")], "document_id long, row_id string"))) == [(1, "possible_duplicate_supporting_charge"), (1, "receipt_duplicate_pair_invalid")]


def test_service_dates_of_neighbours(spark):
    from corvata.operators import servicedates

    s = "document_id long, table_id string, row_order int, kind string, own_date string, lane_value string, description string"
    rows = [
        (0, "charge", None, "IP/12", "Room"), (1, "date_only", "2026-01-05", "", ""), (2, "charge", None, "", "Nursing"), (3, "charge", None, "IP/13", "Diet"), (4, "date_only", "2026-01-07", "", "visit fee"),
        (5, "charge", "2026-01-09", "x", "Visit"), (6, "other", None, "", ""), (7, "date_only", "2026-01-08", "", ""), (8, "charge", None, "", "Gauze"), (9, "charge", None, "", "Gloves"),
    ]
    df = spark.createDataFrame([(1, "t", *r) for r in rows], s).withColumn("own_date", F.col("own_date").cast("date"))
    got = {r.row_order: (str(r.service_date), r.how) for r in servicedates.recovered(df).collect()}
    assert got == {0: ("2026-01-05", "attached"), 2: ("2026-01-05", "carried"), 3: ("2026-01-07", "attached"), 5: ("2026-01-09", "own"), 8: ("2026-01-08", "following"), 9: ("None", None)}
    s = "document_id long, table_id string, row_order int, own_date string, explicit boolean, lane string"
    rows = [(1, "t", 0, "2026-01-05", True, "a"), (1, "t", 1, "2026-02-05", False, "b"), (1, "t", 2, "2026-02-20", False, "b"), (1, "t", 3, "2027-02-20", True, "a"), (1, "t", 4, "2025-01-01", False, "b"), (2, "t", 0, "2026-02-05", False, "b")]
    df = spark.createDataFrame(rows, s).withColumn("own_date", F.col("own_date").cast("date"))
    kept = {(r.document_id, r.row_order) for r in servicedates.believed(df).where("own_date is not null").collect()}
    assert kept == {(1, 0), (1, 1), (1, 2), (1, 3)}
