"""The composed merge and what it is made of, against small cases worked out by hand and plain models."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyforge.operators import classify, extract, lifecycle, merge, normalize

COLUMNS = ["carrier_name", "carrier_account_number", "sub_account_number_1", "master_account", "phone_number", "btn", "usoc", "service_type", "service_or_component", "row_type", "component_or_feature_name", "carrier_circuit_number", "monthly_recurring_cost", "contract_number", "service_address_1", "service_address_2", "city", "state", "zip", "country", "billing_name", "charge_type"]
SCHEMA = "doc_id string, doc_type string, doc_seq int, row_seq int, " + ", ".join(f"{c} {'decimal(12,2)' if c == 'monthly_recurring_cost' else 'string'}" for c in COLUMNS)


def row(doc, kind, seq, n, **values):
    from decimal import Decimal

    return (doc, kind, seq, n, *(Decimal(values[c]) if c == "monthly_recurring_cost" and c in values else values.get(c) for c in COLUMNS))


def test_merge_of_documents(spark):
    rows = [
        row("i", "invoice", 0, 0, carrier_account_number="6145550001234", sub_account_number_1=" ", phone_number="6145551111", row_type="S", component_or_feature_name="Line", monthly_recurring_cost="10.00", city="Dayton", billing_name="--"),
        row("c", "csr", 1, 0, carrier_account_number="6145550001234", phone_number="6145551111", row_type="S", component_or_feature_name="Line", monthly_recurring_cost="9.00", city="Columbus", usoc="1MB"),
        row("i", "invoice", 0, 1, carrier_account_number="9990001", phone_number="6145552222", row_type="S", component_or_feature_name="Line"),
        row("k", "contract", 2, 0, carrier_account_number="6145550001", contract_number="K7", zip="43215"),  # begins the first account
        row("k", "contract", 2, 1, carrier_account_number="9990001", sub_account_number_1="", contract_number="K9"),
        row("s", "subscription", 3, 0, carrier_account_number="6145550001234", phone_number="6145551111", row_type="S", component_or_feature_name="Line"),  # there already
        row("s", "subscription", 3, 1, carrier_account_number="6145550001234", component_or_feature_name="Extra"),  # an account only: new
        row("s", "subscription", 3, 2, component_or_feature_name="Nobody's"),  # no key at all: new
        row("s", "subscription", 3, 3, carrier_account_number="777", phone_number="6145553333", component_or_feature_name="New line"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    normal = normalize.Rules(billing_name_placeholders=["--"], derive_month_to_month=False, derive_billing_per_contract=False)
    got, conflicts = merge.merge_with_conflicts(df, {"contract": "enrichment", "subscription": "supplemental"}, [c for c in COLUMNS if c != "charge_type"], normal=normal)
    by = {(r.doc_id, r.row_seq): r for r in got.collect()}
    assert set(by) == {("i", 0), ("i", 1), ("s", 1), ("s", 2), ("s", 3)}
    first = by["i", 0]
    assert (float(first.monthly_recurring_cost), first.usoc, first.city, first.billing_name) == (10.0, "1MB", "Columbus", None)
    assert by["i", 1].contract_number == "K9"  # a blank sub-account doesn't hide the account
    assert by["s", 1].city == "Columbus"  # spread along the account
    assert by["s", 2].city is None and by["s", 3].city is None
    assert conflicts.filter("field = 'city'").count() == 0  # csr leads there, so it is none


def test_accounts_that_begin_longer_ones_share_terms(spark):
    rows = [row("i", "invoice", 0, 0, carrier_account_number="6145550001234", row_type="S", phone_number="1"), row("j", "invoice", 1, 0, carrier_account_number="614-555-0001", row_type="S", phone_number="2", contract_number="K7", city="Dublin", zip="43017")]
    fields = ["carrier_account_number", "phone_number", "row_type", "contract_number", "city", "zip", "country"]
    rules = merge.MergeRules(non_propagating=["city"])
    got = {r.doc_id: r for r in merge.propagate(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert (got["i"].contract_number, got["i"].city, got["i"].country) == ("K7", None, "USA") and len(fields) == 7


def test_equal_accounts_meet_by_their_roots(spark):
    rows = [row("i", "invoice", 0, 0, carrier_account_number="100", master_account="55", phone_number="1", row_type="S"), row("k", "contract", 1, 0, carrier_account_number="55", contract_number="K1")]
    got = merge.merge_documents(spark.createDataFrame(rows, SCHEMA), {"contract": "enrichment"}, [c for c in COLUMNS if c != "charge_type"]).collect()
    assert [r.contract_number for r in got] == ["K1"]


def test_merge_fields_against_a_plain_model(spark):
    from tallyforge.schema import BASE_ORDER, PRIORITY, UNLISTED

    random.seed(3)
    rows = [row(f"d{i % 7}", random.choice(["invoice", "csr", "contract", "did_list"]), i % 7, i, carrier_account_number=random.choice(["", "1", "2", "3", None]), usoc=random.choice([None, "A", "B"]), city=random.choice([None, "X", "Y"]), phone_number=random.choice([None, "5", "6"])) for i in range(300)]
    fields = ["usoc", "city", "phone_number"]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.carrier_account_number: tuple(r[f] for f in fields) for r in merge.merge_fields(df, ["carrier_account_number"], fields).collect()}
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.carrier_account_number].append(r)
    assert len(got) == len(groups)
    for k, g in groups.items():
        one = len({r.doc_type for r in g}) == 1
        g.sort(key=lambda r: (-(sum(r[f] is not None for f in fields) if one else BASE_ORDER.get(r.doc_type, 1)), r.doc_seq, r.row_seq))
        out = []
        for f in fields:
            p = lambda kind: PRIORITY[f].get(kind, UNLISTED)  # noqa: B023, E731
            value = g[0][f]
            for r in g[1:]:
                if r[f] is not None and (value is None or r.doc_type != g[0].doc_type and p(r.doc_type) > p(g[0].doc_type)):
                    value = r[f]
            out.append(value)
        # a value that only fills a blank never gives way to a later filler
        expected = []
        for f, v in zip(fields, out):
            p = lambda kind: PRIORITY[f].get(kind, UNLISTED)  # noqa: B023, E731
            wins = [r[f] for r in g if r[f] is not None and r.doc_type != g[0].doc_type and p(r.doc_type) > p(g[0].doc_type)]
            expected.append(wins[-1] if wins else g[0][f] if g[0][f] is not None else next((r[f] for r in g if r[f] is not None), None))
        assert got[k] == tuple(expected)


def test_one_account_with_half_of_the_rows(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("id").cast("string")).alias("account_group"), F.when(F.col("id") == 10, "K").alias("contract_number"), F.lit(0).alias("doc_seq"), F.col("id").cast("int").alias("row_seq"))
    out = merge.propagate_account(rows, fields=["contract_number"])
    assert out.filter("contract_number = 'K'").count() == 10_000 and out.count() == 20_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_prefixes(spark):
    keys = ["5550100001", "5550100001234", "55501", "5550100", "555010000123", "5550999", "x5550100001"]
    got = {r.key: r.target for r in merge.prefix_bridge(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "account string, first_seen int")).collect()}
    digit = [k for k in keys if k.isdigit() and len(k) >= 7]
    assert got == {k: max((m for m in digit if m != k and m.startswith(k)), key=len) for k in digit if any(m != k and m.startswith(k) for m in digit)}


def test_repeated_files_stay(spark):
    files = spark.createDataFrame([("1", "ATT_1.pdf", "x"), ("1", "ATT_1.pdf", "x"), ("2", None, "y")], "doc_id string, file_name string, content string")
    rules = spark.createDataFrame([("att", "invoice", "^ATT", 0.9, 1), ("bell", "csr", "^ATT", 0.9, 0)], "carrier string, doc_type string, pattern string, confidence double, position int")
    got = classify.by_filename(files, rules).orderBy("doc_id").collect()
    assert [(r.doc_id, r.carrier, r.level) for r in got] == [("1", "bell", "high"), ("1", "bell", "high"), ("2", None, "low")]
    assert classify.by_filename(files, rules.limit(0)).count() == 3


def test_unavailable_fields_and_sections(spark):
    df = spark.createDataFrame([("box", "csr", "d"), ("box", "contract", "d"), (None, "csr", "d")], "format_variant string, doc_type string, contract_begin_date string")
    assert [r.contract_begin_date for r in extract.without_unavailable(df, {"box": ["contract_begin_date", "not there"]}).collect()] == [None, "d", "d"]
    assert extract.extractable(spark.createDataFrame([(None,), ("index",), ("x",)], "section_type string")).count() == 2


def test_versions_follow_content(spark):
    rows = lambda v: spark.createDataFrame([("u", 0, "a"), ("u", 1, v), ("w", 0, None)], "upload_id string, row_seq int, payload string")
    none = spark.createDataFrame([], "upload_id string, version int, content_hash string")
    one = lifecycle.snapshot(rows("b"), none)
    two = lifecycle.snapshot(rows("c"), one)
    same = lifecycle.snapshot(rows("c").orderBy(F.desc("row_seq")), two)
    assert sorted((r.upload_id, r.version) for r in same.collect()) == [("u", 0), ("u", 1), ("w", 0)]


def test_configuration(spark, tmp_path):
    from tallyforge.sources.config import ConfigStore

    home = tmp_path / "carriers" / "bell"
    (home / "formats").mkdir(parents=True)
    (home / "prompts").mkdir()
    (home / "domain_knowledge").mkdir()
    (home / "carrier.yaml").write_text('{"name": "Bell", "aliases": ["Old Bell"], "filename_patterns": {"invoice": [{"pattern": "BELL_", "confidence": 0.95}], "csr": null}, "first_page_signals": {"required_any": ["Bell Co"], "doc_type_markers": {"invoice": ["Amount Due"]}}, "merge_rules": {"doc_type_roles": {"contract": "enrichment", "invoice": "primary"}, "account_normalization": {"canonical_length": 13, "check_digit_position": "trailing"}, "sub_account_in_merge_key": false, "non_propagating_fields": ["city"]}}')
    (home / "formats" / "box.yaml").write_text('{"name": "box", "signature": {"required_patterns": ["RECORD"], "any_of_patterns": ["SUB", "TOTAL"]}, "extractable_fields": {"not_available": ["zip"]}}')
    (home / "prompts" / "csr.md").write_text("Read.\nThen answer.")
    (home / "domain_knowledge" / "usoc_codes.yaml").write_text('{"1MB": "Business line"}')
    store = ConfigStore(spark, f"file://{tmp_path}")
    assert store.carrier_by_alias("from OLD BELL, 1999") == "bell" and store.carrier_by_alias("x") is None
    assert store.format_of("bell", "a record\nsubtotal") == "box" and store.format_of("bell", "a record") is None
    assert store.unavailable("bell") == {"box": ["zip"]} and store.prompt("bell", "csr") == "Read.\nThen answer." and store.knowledge("bell")["usoc_codes"] == {"1MB": "Business line"}
    rules = store.merge_rules("bell")
    assert (rules.roles, rules.canonical, rules.check_digit, rules.with_sub_account, rules.non_propagating) == ({"contract": "enrichment", "invoice": "base"}, 13, True, False, ["city"])
    assert store.merge_rules(None).roles == {} and store.registry().first()["display"] == "Bell"
    files = spark.createDataFrame([("1", "BELL_3.pdf")], "doc_id string, file_name string")
    assert classify.by_filename(files, store.filename_patterns()).first()["carrier"] == "bell"
    assert classify.by_content(spark.createDataFrame([("Bell Co\nAmount Due 3",)], "text string"), store.signals()).first()["doc_type"] == "invoice"
    (home / "prompts" / "csr.md").write_text("New.")
    store.reload()
    assert store.prompt("bell", "csr") == "New."


def test_known_identifiers(spark):
    from tallyforge.operators import merge

    known = spark.createDataFrame([("614555", "phone", "bell"), ("9", "account", "att"), ("9", "account", "zip"), ("9", "btn", "other")], "identifier string, identifier_type string, carrier string")
    rows = spark.createDataFrame([(1, "9-", "614-555", "x", "low"), (2, "8", "614555", "x", "medium"), (3, None, None, "y", "high"), (4, "", "777", None, "high"), (5, "8", "1", "w", "low")], "id int, carrier_account_number string, phone_number string, carrier_name string, confidence string")
    got = merge.known_accounts(rows, known)
    assert {r.id: (r.known_carrier, r.confidence) for r in got.collect()} == {1: ("att", "high"), 2: ("bell", "high"), 3: (None, "high"), 4: (None, "high"), 5: (None, "low")}
    assert got.count() == 5 and got.columns == [*rows.columns, "known_carrier"]
    assert sorted(map(tuple, merge.learn_accounts(known, rows).subtract(known).collect())) == [("8", "account", "x")]


def test_merged_rows_move_once(spark):
    """Rows go to their group as they are, and the join and the second aggregate find them there: of two exchanges one moves rows, the other what
    leads a group."""
    rows = [row("i", "invoice", 0, n, carrier_account_number=None if n % 3 else "1", usoc="A") for n in range(9)]
    made = merge.merge_fields(spark.createDataFrame(rows, SCHEMA), ["carrier_account_number", "usoc"], ["city"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert sorted((r.carrier_account_number or "", r.merged_rows) for r in made.collect()) == [("", 6), ("1", 3)]  # nulls are one group


def test_a_blank_value_of_the_line_is_found(spark):
    """A line's value stands, even a blank one; the account's is for fields of which the line says nothing."""
    kinds = "doc_id string, doc_type string, doc_seq int, row_seq int, tier_key string, tier int, account string, city string, zip string"
    target = spark.createDataFrame([("i", "invoice", 0, 0, "k", 1, "a", None, "")], kinds)
    source = spark.createDataFrame([("c", "contract", 1, 0, "k", 1, "a", "", None), ("c", "contract", 1, 1, "a", 3, "a", "Dayton", "43215")], kinds)
    got = merge.enrich(target, source, ["city", "zip"]).first()
    assert (got.city, got.zip) == ("", "43215")
