"""Reference operators on small cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge import schema
from tallyforge.functions import terms
from tallyforge.functions import text as X
from tallyforge.operators import chunk, classify, evaluate, feedback, lifecycle, marts, merge, normalize, quality

ROW = "doc_id string, doc_type string, doc_seq int, row_seq int"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("name,kind", [
    ("ATT_BILL1.pdf", "invoice"), ("x_csr.pdf", "csr"), ("Signed Quote.pdf", "contract"), ("usage.csv", "report"), ("did-list.txt", "did_list"), ("plan details.pdf", "subscription"), ("a.eml", "email"), ("billboard.pdf", None), ("scan.pdf", None)])
def test_document_type(spark, name, kind):
    assert one(spark, name, X.document_type) == kind


def test_text_functions(spark):
    assert one(spark, "Channel Fee - Qty 15", X.service_name) == "channel fee" and one(spark, "Fee (qty: 2) ", X.service_name) == "fee"
    assert one(spark, "614-555.0", X.without_point_zero) == "614-555" and one(spark, "v2.0", X.without_point_zero) == "v2.0" and one(spark, "614 555.0", X.without_point_zero) == "614 555"
    assert one(spark, "BusLocalCalling", X.component_name) == "businesslocalcalling"
    assert one(spark, "THREEWay calling", X.camel_split) == "three way calling"
    assert one(spark, "WindstreamCommunicationsInc", X.carrier) == "WINDSTREAM" and one(spark, "Zeta & Co", X.carrier) == "ZETACO"
    assert one(spark, "520S9THST", X.respaced) == "520 S 9TH ST"
    assert one(spark, "No, rate $13", X.dollar) is None and one(spark, "No($1,095.50)", X.dollar) == Decimal("1095.50")
    assert one(spark, "0.125", X.amount) == Decimal("0.12") and one(spark, "3.9", X.whole) == 3
    assert one(spark, "3/5/2024", X.parsed_date) == dt.date(2024, 3, 5) and one(spark, "2024-03-05 10:00:00", X.parsed_date) == dt.date(2024, 3, 5)
    assert one(spark, "AT&T  Ohio", X.slug) == "at_and_t_ohio"
    r = one(spark, "SB\nACMECORP\n520 MAIN\nCOLUMBUS, OH 43215", X.address_block)
    assert (r.billing_name, r.service_address_1, r.city, r.state, r.zip) == ("ACMECORP", "520 MAIN", "COLUMBUS", "OH", "43215")


def test_terms(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), 1, dt.date(2024, 2, 29))], "b date, m int, e date")
    assert df.select(terms.term_matches(F.col("b"), F.col("m"), F.col("e"), 0)).first()[0]
    assert one(spark, 'x ```json\n[{"a": "1"}]\n``` y', terms.salvaged_json) == [{"a": "1"}] and one(spark, 'so {"a": "2"} it is', terms.salvaged_json) == [{"a": "2"}] and one(spark, "none", terms.salvaged_json) is None


def test_merge_takes_priorities_of_the_base_document(spark):
    rows = [("i", "invoice", 0, 0, "k", "A", "12.00", None), ("c", "csr", 1, 0, "k", "B", "10.00", "X1"), ("t", "contract", 2, 0, "k", "C", None, None)]
    df = spark.createDataFrame(rows, ROW + ", k string, city string, monthly_recurring_cost string, usoc string")
    r = merge.merge_fields(df, ["k"], ["city", "monthly_recurring_cost", "usoc"]).first()
    assert (r.city, r.monthly_recurring_cost, r.usoc, r.merged_rows) == ("C", "12.00", "X1", 3)


def test_merge_of_one_kind_starts_with_the_fullest_row(spark):
    df = spark.createDataFrame([("a", "csr", 0, 0, "k", None, "1"), ("b", "csr", 1, 0, "k", "x", "2")], ROW + ", k string, city string, usoc string")
    assert merge.merge_fields(df, ["k"], ["city", "usoc"]).first().usoc == "2"


def test_accounts(spark):
    df = spark.createDataFrame([("contract", "555-010-0001 & 555-010-0002"), ("contract", "5550100001 & x"), ("invoice", "5550100001 & 5550100002")], "doc_type string, carrier_account_number string")
    assert sorted(r[1] for r in merge.split_accounts(df).collect()) == ["555-010-0001", "555-010-0002", "5550100001 & 5550100002", "5550100001 & x"]
    keys = spark.createDataFrame([("5550100001", 0), ("5550100001234", 1), ("55501", 2)], "account string, first_seen int")
    assert [tuple(r) for r in merge.prefix_bridge(keys).collect()] == [("5550100001", "5550100001234")]
    acct = spark.createDataFrame([("12345678901234",), ("123456789012345",)], "a string").select(X.account(F.col("a"), 13, True).alias("r")).collect()
    assert [r.r for r in acct] == ["1234567890123", "123456789012345"]
    edges = spark.createDataFrame([("A", "M"), ("B", "M"), ("CC", "CC")], "a string, b string")
    assert {r.id: r.root for r in merge.account_components(edges).collect()} == {"A": "A", "B": "A", "M": "A", "CC": "CC"}


def test_service_clusters(spark):
    names = ["Monthly Fee - X", "Monthly Fee - X extra", "Fee - X", "Fee - X long extra", "Monthly Channel Fee", "Monthly Channel Fee - SDC"]
    df = spark.createDataFrame([("d", "invoice", 0, i, "k", n, None, None) for i, n in enumerate(names)], ROW + ", k string, component_or_feature_name string, service_type string, usoc string")
    assert [r.cluster for r in merge.cluster_services(df, "k").orderBy("row_seq").collect()] == [0, 0, 1, 2, 3, 3]


def inventory_row(**kw):
    return tuple(kw.get(f.name) for f in schema.RECORD)


def test_validation_and_compliance(spark):
    base = {"carrier_name": "A", "carrier_account_number": "1", "quantity": 3, "cost_per_unit": Decimal("2.00")}
    day = dt.date(2024, 1, 1)
    rows = [
        {**base, "row_seq": 0, "monthly_recurring_cost": Decimal("6.02"), "contract_number": "n"}, {**base, "row_seq": 1, "monthly_recurring_cost": Decimal("6.03"), "contract_number": "n"},
        {**base, "row_seq": 2, "contract_begin_date": day, "contract_expiration_date": day}, {"row_seq": 3, "contract_begin_date": dt.date(2024, 2, 1), "contract_expiration_date": day, "phone_number": "12"},
        {**base, "row_seq": 4, "quantity": None, "monthly_recurring_cost": Decimal("96.00"), "billing_per_contract": "No(contract rate $95)", "contract_number": "n"}, {**base, "row_seq": 5, "quantity": None, "monthly_recurring_cost": Decimal("120.00"), "billing_per_contract": "No (contract rate $95)", "contract_number": "n"},
        {**base, "row_seq": 6, "quantity": None, "monthly_recurring_cost": Decimal("5.00")}]
    df = quality.audit(spark.createDataFrame([inventory_row(**r) for r in rows], schema.RECORD), F.lit(dt.date(2025, 1, 1)))
    got = {r.row_seq: r for r in df.collect()}
    kinds = lambda n: [(i.field, i.severity) for i in got[n].issues]
    assert kinds(0) == [] and kinds(1) == [("monthly_recurring_cost", "warning")] and kinds(2) == [("contract_expiration_date", "info")]
    assert ("contract_expiration_date", "error") in kinds(3) and ("phone_number", "warning") in kinds(3) and got[3].status == "Needs Review"
    flags = lambda n: [(f.check, f.severity) for f in got[n].compliance_flags]
    assert flags(4) == [("rate_mismatch", "warning")] and flags(5) == [("rate_mismatch", "error")] and flags(6) == [("no_contract", "info")]
    levels = df.select("row_seq", quality.confidence().alias("m")).filter("row_seq = 3").first()["m"]
    assert levels["phone_number"] == "medium" and levels["zip"] == "missing"
    assert df.select(quality.overall_confidence(F.create_map(F.lit("a"), F.lit("high"), F.lit("b"), F.lit("medium")), ["b", "a"]).alias("o")).first().o == "medium"


@pytest.mark.parametrize("field,e,g,score", [
    ("phone_number", "5551234", "6145551234", "CORRECT"), ("monthly_recurring_cost", "1.00", "1.01", "CORRECT"), ("monthly_recurring_cost", "1.00", "1.02", "WRONG"), ("carrier_account_number", "6145551234152", "614555123415", "CORRECT"),
    ("quantity", "3.0", "3", "CORRECT"), ("carrier_name", "AT&T", "ATT Ohio", "CORRECT"), ("carrier_name", "AT&T", "Zeta", "WRONG"), ("carrier_name", "Charter", "Spectrum Business", "CORRECT"), ("city", "Columbus", "columbus oh", "PARTIAL"), ("city", None, "N/A", "BOTH_EMPTY"), ("city", None, "x", "MISSING"), ("city", "x", "", "EXTRA"),
    ("contract_begin_date", "2024-01-02", "01/02/2024", "CORRECT"), ("component_or_feature_name", "BusLocalCalling", "Business Local-Calling", "CORRECT")])
def test_field_scores(spark, field, e, g, score):
    df = spark.createDataFrame([(e, g)], "e string, g string")
    assert df.select(evaluate.compare(field, F.col("e"), F.col("g"))).first()[0] == score


def test_row_matching(spark):
    cols = "row_id int, row_seq int, carrier_account_number string, sub_account_number_1 string, sub_account_number_2 string, phone_number string, btn string, charge_type string, service_or_component string, row_type string, usoc string, component_or_feature_name string, monthly_recurring_cost string"
    row = lambda i, acct, sub, phone, charge, name, mrc: (i, i, acct, sub, None, phone, None, charge, "S", None, None, name, mrc)
    golden = spark.createDataFrame([row(1, "111", None, "6145550001", "MRC", "Fee", "1"), row(2, "111", None, "6145550001", "MRC", "Line", "2"), row(3, "222", None, "6145550002", "Tax", "T", "3"), row(4, "333", None, "", "MRC", "Z", "4")], cols)
    extracted = spark.createDataFrame([row(10, "111", None, "6145550001", "MRC", "Line", "2"), row(11, "111", None, "6145550001", "MRC", "other", "1"), row(12, "222", None, "6145550002", "MRC", "T", "3"), row(13, "999", "333", "", "MRC", "Z", "4")], cols)
    got = {(r.golden_id, r.extracted_id, r.pass_) for r in evaluate.match_rows(golden, extracted).collect()}
    assert got == {(2, 10, 1), (1, 11, 1), (3, 12, 2), (4, 13, 3)}


def test_feedback(spark):
    c = lambda *rows: spark.createDataFrame(rows, "field_name string, extracted_value string, corrected_value string, root_cause string")
    assert feedback.hints(c(("f", "a", "b", "EXTRACTION"))).count() == 0 and feedback.hints(c(*[("f", "a", "b", "MERGE")] * 3)).count() == 0
    got = feedback.hints(c(*[("f", "a", "b", "EXTRACTION")] * 3, *[("g", "a", "b", "EXTRACTION")] * 2)).collect()
    assert [(r.field_name, r.n) for r in got] == [("f", 3), ("g", 2)]
    kinds = {r.field_name: r.suggestion for r in feedback.patterns(c(*[("service_type", "a", "b", "EXTRACTION")] * 3, *[("x", "a", "b", "DATA_GAP")] * 3, *[("y", "a", "b", "MERGE")] * 3, *[("z", "a", "b", "EXTRACTION")] * 2)).collect()}
    assert kinds == {"service_type": "service_type", "x": "data_gap", "y": "merge_rule"}
    raw = spark.createDataFrame([("f1", "6145550001", "", "city", "Right"), ("f2", "6145550002", "", "city", "wrong"), ("f3", "6145559999", "", "city", "Far")], "doc_id string, account string, phone string, field_name string, value string")
    asked = spark.createDataFrame([(1, "city", "x", "right", "6145550001", None), (2, "city", "Wrong", "new", "6145550002", None), (3, "city", "x", "far", "7770000000", None), (4, "city", "x", "nowhere", "7770000000", None)], "id int, field_name string, extracted_value string, corrected_value string, account string, phone string")
    assert {r.id: r.root_cause for r in feedback.diagnose(asked, raw).collect()} == {1: "MERGE", 2: "EXTRACTION", 3: "ENRICHMENT", 4: "DATA_GAP"}


def test_chunks(spark):
    assert chunk.packed("aaaa\n\nbbbb\n\ncccc", 10) == ["aaaa\n\nbbbb", "cccc"] and chunk.packed("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    df = spark.createDataFrame([(1, "head\nACTIVITY FOR ACCOUNT - 123\na\nACTIVITY FOR ACCOUNT - 456\nb")], "doc_id int, text string")
    assert [r.sub_account for r in chunk.by_boundary(df, r"ACTIVITY FOR ACCOUNT - (\d+)").orderBy("section").collect()] == ["123", "456"]
    marks = spark.createDataFrame([(1, "x ---BILL--- a ---LISTINGS--- b")], "doc_id int, text string")
    assert [r.section_name for r in chunk.by_markers(marks, ["---BILL---", "---LISTINGS---"]).orderBy("section").collect()] == ["bill", "listings"]
    s = one(spark, "x\nLOCATION SUMMARY\n12345 Main $1.00 $1,234.50\nnothing\n\n", chunk.location_totals)
    assert [(r.account, r.total) for r in s] == [("12345", 1234.5)]


def test_normalisation(spark):
    df = spark.createDataFrame([(1, "Actve"), (2, "ACTIVE"), (3, "live"), (4, "zzz"), (5, None)], "i int, status string")
    got = {r.i: (r.status_how, r.status) for r in normalize.vocabulary(df, "status", ["Active", "Pending"], {"live": "Active"}).collect()}
    assert got[2] == ("exact", "Active") and got[3] == ("synonym", "Active") and got[4] == ("unknown", "zzz") and got[5][0] == "blank" and got[1][0] in ("fuzzy", "unknown")
    names = spark.createDataFrame([("Zeta Networks",), ("Voice",), ("$12",), ("A1234",)], "n string")
    assert [r[0] for r in names.filter(normalize.plausible_carrier(F.col("n"))).collect()] == ["Zeta Networks"]
    good, bad = normalize.typed_rows(spark.createDataFrame([(1, '{"row_type": "S", "monthly_recurring_cost": "$1,200.50", "quantity": "2.0", "odd": "x"}'), (2, "no json")], "i int, raw string"))
    r = good.first()
    assert (r.row_type, r.service_or_component, r.monthly_recurring_cost, r.quantity) == ("S", "S", Decimal("1200.50"), 2) and [b.i for b in bad.collect()] == [2]


def test_life_cycle(spark):
    rows = spark.createDataFrame([(1, "A", "614-555", None, "x", "5"), (2, "B", "999", "6145551234", "x", "5")], "row_id int, carrier_name string, carrier_account_number string, phone_number string, city string, quantity string").withColumn("quantity", F.col("quantity").cast("int"))
    entries = spark.createDataFrame([(1, "a", None, {"carrier_account_number": "614555"}, {"city": "one", "quantity": "7"}), (2, "zz", None, {"carrier_account_number": "614555"}, {"city": "two"}), (3, None, None, {"phone_number": "(614) 555-1234"}, {"city": "three", "quantity": "bad"})], "entry_seq int, carrier string, account_number string, key_fields map<string,string>, values map<string,string>")
    got = {r.row_id: (r.city, r.quantity) for r in lifecycle.apply_master_data(rows, entries, ["city", "quantity"]).collect()}
    assert got == {1: ("one", 7), 2: ("three", 5)}
    old = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert sorted((r.k or "", r.v) for r in lifecycle.upsert(old, spark.createDataFrame([(None, 9)], "k string, v int"), ["k"]).collect()) == [("", 9), ("a", 2)]
    cells = spark.createDataFrame([(0, "1.00", "1.004"), (1, "a", " "), (2, "a", "b"), (3, "2024-01-02", "1/2/2024")], "row_seq int, a string, b string")
    assert [r.row_seq for r in lifecycle.diff(cells.select("row_seq", F.col("a").alias("f")), cells.select("row_seq", F.col("b").alias("f")), ["f"]).collect()] == [2]


def test_classification(spark):
    reg = spark.createDataFrame([("att", "AT&T", ["ATT"], 0), ("ntt", "NTT Communications", [], 1)], "key string, display string, aliases array<string>, position int")
    names = spark.createDataFrame([("AT&T California",), ("NTT",), ("Nobody",)], "name string")
    assert {r.name: r.canonical for r in classify.match_names(names, reg).collect()} == {"AT&T California": "AT&T", "NTT": "NTT Communications", "Nobody": "Nobody"}
    files = spark.createDataFrame([("alpha telecom alpha telecom 123-4567",), ("alpha and beta",)], "text string")
    got = classify.deep_scan(files, [("a", "Alpha Telecom", ["alpha"], [r"\d{3}-\d{4}"]), ("b", "Beta", ["beta"], [])]).collect()
    assert [(r.carrier, r.points) for r in got] == [("a", 17), (None, 15)] or [(r.carrier, r.points) for r in got][0] == ("a", 17)


def test_reports(spark):
    df = spark.createDataFrame([("a", None), ("", 1), ("b", 2)], "s string, n int")
    assert {r.field: r.rate for r in marts.fill_rates(df, ["s", "n"]).collect()} == {"s": 66.7, "n": 66.7}
    order = spark.createDataFrame([("a10",), ("a9",), ("A2",)], "s string")
    assert [r.s for r in order.orderBy(marts.natural_order(F.col("s"))).collect()] == ["A2", "a9", "a10"]


def test_document_types_of_all_names(spark):
    from tallyforge.plans import catalogue

    kinds = ["invoice", "csr", "contract", "report", "did_list", "subscription", "email", None]
    pages = {r.page_id for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id").collect()}
    got = {r.page_id: r.doc_type for r in catalogue.queries()["f17_document_types_all"](spark, "/root/testdata/sf0.01").collect()}
    assert max(pages) > 16 and got == {p: kinds[p % 8] for p in pages}


def test_diagnosis_by_accounts_against_a_plain_model(spark):
    import random

    from tallyforge.operators import feedback

    rng = random.Random(5)
    account = lambda: "".join(rng.choice("12") for _ in range(rng.choice([0, 2, 3, 4, 6])))
    phone = lambda: rng.choice(["", "", "6145550001", "5550001", "5550002", "2"])
    value = lambda: rng.choice(["", "a", "b ", "C", None, "d", "e"])
    corrections = [(i, rng.choice("fg"), value(), value(), account() or None, phone(), rng.choice("xy")) for i in range(150)]
    raw = [(f"d{i:03}", account(), phone() or None, rng.choice("fg"), value(), rng.choice("xy")) for i in range(25)] + [("d999", "1" * 40, None, "f", "a", "x")] * 50
    up = lambda v: (v or "").strip().upper()

    def cause(i, f, was, right, a, p, carrier):
        own = [r for r in raw if r[3] == f and r[5] == carrier]
        met = sorted((r[0], up(r[4])) for r in own if (p and r[2] and p[-7:] == r[2][-7:]) or (a and r[1] and (a in r[1] or r[1] in a)))
        if up(right) in [v for _, v in met]:
            return "MERGE"
        first = [v for _, v in met if v]
        return ("EXTRACTION" if first[0] == up(was) else "MERGE") if first else "ENRICHMENT" if up(right) in [up(r[4]) for r in own] else "DATA_GAP"

    c = spark.createDataFrame(corrections, "id int, field_name string, extracted_value string, corrected_value string, account string, phone string, carrier string")
    r = spark.createDataFrame(raw, "doc_id string, account string, phone string, field_name string, value string, carrier string")
    got = {x.id: x.root_cause for x in feedback.diagnose(c, r).collect()}
    assert got == {x[0]: cause(*x) for x in corrections} and set(got.values()) == {"MERGE", "EXTRACTION", "ENRICHMENT", "DATA_GAP"}
