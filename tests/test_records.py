"""Records in their own shapes, the ledger, matching under any account, picks, ranks and sums by ranges."""

import datetime
import difflib
import math
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import terms
from tallyforge.operators import chunk, evaluate, feedback, graph, marts, merge, normalize
from tallyforge.plans import catalogue, records


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


def test_summaries(spark):
    text = "LOCATION SUMMARY\n12345 Main $1.00 $1,234.50\n123456789012 Far $2.00\nTotals $9.00\n 12345 again 5 $7.25\n1234 short $1.00\n67890 none\n\n99999 usage $3.00\n"
    assert [tuple(t) for t in one(spark, text, chunk.location_totals)] == [("12345", 7.25), ("123456789012", 2.0)]
    assert one(spark, "LOCATION SUMMARY\n12345 a $1.00\n", chunk.location_totals) == []  # nothing ends it
    assert one(spark, "---REVENUE AMOUNTS---\nTOTAL 5.00\nLOCAL SERVICE TOTAL  12.50\n", chunk.revenue_total) == 12.5
    assert one(spark, "---REVENUE AMOUNTS---\n---\nLOCAL SERVICE TOTAL 12.50\n", chunk.revenue_total) is None and one(spark, "TOTAL $5.00", chunk.revenue_total) is None
    box = "SERV & EQUIP ACCOUNT SUMMARY\n! ! 1 !1MB Business line !\n!2 !\n! ! 12 !9ZR  End user ! x !\n!----------!\n! ! 3 !NOT of it !"
    assert [tuple(t) for t in one(spark, box, chunk.code_descriptions)] == [("1MB", "Business line"), ("9ZR", "End user")]
    for name, text, said in (("---REVENUE AMOUNTS---", "---REVENUE AMOUNTS--- LOCAL SERVICE TOTAL 3.5", '{"revenue_total":3.5}'), ("SERV & EQUIP ACCOUNT SUMMARY", box, '{"usoc_summary":{"1MB":"Business line","9ZR":"End user"}}'), ("LISTINGS", box, None), ("LOCATION SUMMARY", "x", None)):
        assert one(spark, text, lambda c, name=name: chunk.summary_section(F.lit(name), c)) == said


def test_boxes_to_places(spark):
    text = "X LA !1 ELM, NEW ALBANY,\nDZIP !43054\nSLA !001-5 OAK ST, FL 2, DAYTON /LSO 614\nSLA |002–7 PINE /DPI x, y!z\n/CNUM B2 /CNUM A1\nT /SLA 001\nT /SLA 002 /CNUM B2\nT /SLA 003"
    t = one(spark, text, chunk.address_table)
    assert (tuple(t.main), t.zip, [tuple(s) for s in t.stations], t.contracts) == (("1 ELM", "NEW ALBANY"), "43054", [("001", "5 OAK ST, FL 2", "DAYTON"), ("002", "7 PINE", None)], ["A1", "B2"])
    said = one(spark, text, lambda c: chunk.address_context(chunk.address_table(c)))
    assert said == "\n--- ADDRESS LOOKUP TABLE ---\nDEFAULT_ADDRESS: 1 ELM\nDEFAULT_CITY: NEW ALBANY\nDEFAULT_ZIP: 43054\nSLA_LOOKUP_TABLE:\n  SLA 001 = 5 OAK ST, FL 2, DAYTON\n  SLA 002 = 7 PINE\nCONTRACT_NUMBER: A1\nCONTRACT_NUMBERS_ALT: B2\n--- END ADDRESS TABLE ---\n"
    assert one(spark, "001: 5 Oak Ave\nSLAB !1-x", lambda c: chunk.address_context(chunk.address_table(c))) == ""
    assert one(spark, "LA !1 ELM\nSA !2 MAIN!", chunk.address_table).main.address == "2 MAIN"
    docs = spark.createDataFrame([(1, text), (2, "SLA !001-9 FIR\nT /SLA 001\nT /SLA 9"), (3, None)], "doc_id int, text string")
    got = [(r.doc_id, r.station, r.address, r.city) for r in chunk.placed_lines(docs).filter("station is not null").orderBy("doc_id", "line").collect()]
    assert got == [(1, "001", "5 OAK ST, FL 2", "DAYTON"), (1, "002", "7 PINE", None), (1, "003", "1 ELM", "NEW ALBANY"), (2, "001", "9 FIR", None), (2, "9", None, None)]


def test_address_blocks(spark):
    text = "a\nb\nAcme\n1 Main St\nSubtotal 5\n Dayton \nAccountNumber: 1234567890123\nAccountNumber: 2234567890123\n\nx\nAccountNumber: none\n1\n2\n3\n4\n5\n6\nAccountNumber: 3234567890123 y\nlast\nAccountNumber: 1234567890123"
    got = one(spark, text, lambda c: chunk.address_blocks(c, r"AccountNumber:\s*(\d{13})"))
    assert [tuple(b) for b in got] == [("1234567890123", "last"), ("3234567890123", "2\n3\n4\n5\n6")]
    assert one(spark, "AccountNumber: 1234567890123", lambda c: chunk.address_blocks(c, r"AccountNumber:\s*(\d{13})")) == []


def test_many_accounts_of_one_text(spark):
    """Each step once a text: entries were made anew for every account, 2,000 x 2,000 steps here."""
    text = "".join(f"Acme {i}\n{i} Elm\nAccountNumber: {10**12 + i % 1900}\n\n" for i in range(2_000))
    began = time.time()
    got = [tuple(b) for b in one(spark, text, lambda c: chunk.address_blocks(c, r"AccountNumber:\s*(\d{13})"))]
    assert time.time() - began < 20
    assert got == [(str(10**12 + i), f"Acme {k}\n{k} Elm") for i in range(1_900) for k in [i + 1_900 if i < 100 else i]]


def test_steps_stand_once_in_plans(spark):
    """Nothing is computed again for each place that names it, and gathering lines takes no window."""
    docs = spark.createDataFrame([(1, "SLA !001-9 FIR\nT /SLA 001\nT /SLA 9"), (1, "LA !1 ELM\nT /SLA 001"), (None, "SLA !001-9 FIR\nLA !2 ELM\nT /SLA 001")], "doc_id int, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    told = plan(docs.select(chunk.address_context(chunk.address_table(F.col("text"))).alias("x")))
    assert [told.count(mark) for mark in (r"\bSA\s", r"\bDZIP", r"/CNUM")] == [1, 1, 1]
    for name, mark in (("LOCATION SUMMARY", "LOCATION SUMMARY["), ("SERV & EQUIP ACCOUNT SUMMARY", "ACCOUNT SUMMARY("), ("---REVENUE AMOUNTS---", "AMOUNTS---\\s")):
        assert plan(docs.select(chunk.summary_section(F.lit(name), F.col("text")).alias("x"))).count(mark) == 1
    placed = chunk.placed_lines(docs)
    assert "Join" not in plan(placed) and plan(placed).count(r"\bSA\s") == 1
    assert sorted((r.doc_id or 0, r.line, r.address or "") for r in placed.filter("station is not null").collect()) == [(0, 2, "2 ELM"), (1, 1, "9 FIR"), (1, 1, "9 FIR"), (1, 2, "")]
    lines = spark.createDataFrame([(7, 2, 5, 1, 1.0), (7, 1, 6, 2, 3.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    orders = spark.createDataFrame([(7, 3, "O", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    folder = tempfile.mkdtemp()
    lines.write.parquet(f"{folder}/lineitem.parquet")
    orders.write.parquet(f"{folder}/orders.parquet")
    made = records.box_records(spark, folder)
    assert "Window" not in plan(made) and "! ! 1 !C2 Line 6 of 2 !\n! ! 2 !C1 Line 5 of 1 !\n" in made.first().text


def test_diagnosis_is_of_each_correction(spark):
    """Causes were put together by id, with a row for each correction and line."""
    c = spark.createDataFrame([(1, "f", "x", "y", "12", ""), (1, "f", "x", "z", "12", ""), (None, "f", "q", "w", "123", ""), (2, "f", "u", "t", "", "5551234")], "id int, field_name string, extracted_value string, corrected_value string, account string, phone string")
    raw = spark.createDataFrame([(1, "123", "", "f", "y"), (2, "123", "", "f", "x"), (3, "", "6145551234", "f", "U")], "doc_id int, account string, phone string, field_name string, value string")
    got = feedback.diagnose(c, raw)
    assert sorted((r.id or 0, r.root_cause) for r in got.collect()) == [(0, "MERGE"), (1, "MERGE"), (1, "MERGE"), (2, "EXTRACTION")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate [id#" in line]


def test_scores_number_what_they_need(spark):
    """All columns of the inventory were dealt and written to number its rows."""
    at = datetime.datetime(1998, 1, 1)
    folder = tempfile.mkdtemp()
    spark.createDataFrame([(i, i % 3, "O", 1.0, at, "1-URGENT") for i in range(1, 6)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    df = catalogue.queries()["e4_diagnostic_scores"](spark, folder)
    assert df.count() == 4 and "billing_name" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_made_by_slices(spark):
    """Python held the parts of a whole batch of texts."""
    docs = spark.createDataFrame([(1, "aa\n\nbb\n\ncc"), (2, None), (3, "x" * 11), (4, "ok")], "doc_id int, text string").coalesce(1)
    got = chunk.by_size(docs, 6)
    assert sorted((r.doc_id, r.part, r.part_text) for r in got.collect()) == [(1, 0, "aa\n\nbb"), (1, 1, "cc"), (2, 0, ""), (3, 0, "xxxxxx"), (3, 1, "xxxxx"), (4, 0, "ok")]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_salvage(spark):
    for text, want in (
        ('{"a": "1"} then {"b": "2"}', [{"a": "1"}]), ('x [{"a": "[y]"}] [', [{"a": "[y]"}]), ('```\n{"a": "1"}\n```', [{"a": "1"}]), ("[1, 2", None), ("{ {", None), ('no [x] {"a": "1"}', [{"a": "1"}]), ("", None), (None, None)):
        assert one(spark, text, terms.salvaged_json) == want


def test_reasons(spark):
    rows = [("f", 1, "csr", "9", "400 INVALID_ARGUMENT input token count (1200000) exceeds the maximum (1048576)"), ("f", 2, "inv", None, "TimeoutError"), ("f", 3, None, "1", "token limit\nmore"), ("f", 4, "x", "1", "y"), ("g", 1, "s", "2", "z" * 300), ("h", 1, "s", "2", None)]
    got = {r.file: r.summary for r in marts.error_reasons(spark.createDataFrame(rows, "file string, at int, section string, sub_account string, message string")).collect()}
    assert got["f"] == "section 'csr' too large for the model (1,200,000 input tokens > 1,048,576 max). Pre-parser cap should have prevented this — check carrier config.; section 'inv' (sub_account=None) timed out; section 'None': token limit …"
    assert got["g"] == f"section 's': {'z' * 200}" and got["h"] == "section 's': "


def test_ledger(spark):
    rows = [(i, f"b{i % 3}", "opus", 0, 1_000_000 if i % 4 else 0) for i in range(40)]
    calls = spark.createDataFrame(rows, "at int, backend string, tier string, tokens_in long, tokens_out long").repartition(5)
    told = marts.ledger(calls, ["at"], cap=1_000.0, warn_share=0.8).orderBy("at").collect()
    total, want = 0, []
    for r in rows:
        state = "blocked" if total >= 1_000 else "warning" if total >= 800 else "ok"
        want.append((r[0], state, 0 if state == "blocked" else 75 * (r[4] > 0)))
        total += want[-1][2]
    assert [(r["at"], r.state, float(r.cost)) for r in told] == want
    spent = {r.backend: (r.cost, r.made, r.blocked) for r in marts.spend(calls, ["at"], cap=1_000.0).collect()}
    assert spent[None][0] == total and sum(v[0] for k, v in spent.items() if k) == total and spent[None][1] + spent[None][2] == 40
    assert marts.spend(calls, ["at"], cap=0.0).filter("backend is null").first().blocked == 0
    assert marts.ledger(calls.limit(0), ["at"]).count() == 0


def test_numbers_and_sums_by_ranges(spark):
    rows = [(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 7}", i * 3 % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(6)
    got = {r.id: r.n for r in graph.numbered(df, ["k"], ["v", "id"]).collect()}
    seen = {}
    for i, k, v in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]
    sums, total = {r.id: r.s for r in graph.running(df, ["v", "id"], "v", "s").collect()}, 0
    for i, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        assert sums[i] == total
        total += v


def any_account(golden, extracted):
    """Keys one after the other, in the order of golden rows."""
    def keys(accounts, phone):
        accts = list(dict.fromkeys(a for a in accounts if a)) or [""]
        return [f"{a}|{a[:3] + phone if len(phone) == 7 and len(a) >= 3 else phone}" for a in accts]

    by_key = {}
    for side, rows in (("g", golden), ("e", extracted)):
        for rid, *accounts, phone in rows:
            for k in keys(accounts, phone):
                by_key.setdefault(k, {"g": [], "e": []})[side].append(rid)
    used, pairs = {"g": set(), "e": set()}, set()
    for k in by_key:  # golden rows come first
        free = {s: [r for r in by_key[k][s] if r not in used[s]] for s in "ge"}
        for g, e in zip(free["g"], free["e"]):
            pairs.add((g, e))
            used["g"].add(g)
            used["e"].add(e)
    return pairs


def test_matching_under_any_account(spark):
    r = random.Random(4)
    acct = lambda: r.choice(["", "", "111", "222", "333", "4444", "55555", "666"])
    for hot in (0.1, 0.5):
        rows = [[(100 * side + i if side else i, *(("", "", "") if r.random() < hot else (acct(), acct(), acct())), r.choice(["", "5550100", "6145550100"])) for i in range(70)] for side in (0, 1)]
        frames = [spark.createDataFrame([(i, i, *a, p, "") for i, *a, p in side], "row_id long, row_seq int, carrier_account_number string, sub_account_number_1 string, sub_account_number_2 string, phone_number string, btn string").repartition(3) for side in rows]
        assert {tuple(x) for x in evaluate.pair_by_any_account(*frames).collect()} == any_account(*rows)
    assert evaluate.pair_by_any_account(frames[0].limit(0), frames[1]).count() == 0


def test_rows_of_a_key_move_once(spark, monkeypatch):
    r = random.Random(8)
    cols = "row_id long, row_seq int, carrier_account_number string, sub_account_number_1 string, sub_account_number_2 string, phone_number string, btn string, charge_type string, service_or_component string, row_type string, usoc string, component_or_feature_name string, monthly_recurring_cost string"
    row = lambda i: (i, r.randrange(50), r.choice(["", "1", "1", "2"]), r.choice(["", "", "7"]), None, r.choice(["", "6145550100"]), "", r.choice(["MRC", "Recurring", "Tax", None]), r.choice("SC"), None, r.choice(["", "a"]), r.choice(["BusLine", "busline", "Bus Line", " fee", "", None]), r.choice([None, "1", "2"]))
    sides = [[row(100 * side + i) for i in range(90)] for side in (0, 1)]
    frames = [spark.createDataFrame(x, cols).repartition(3) for x in sides]
    left = [{x["row_id"]: x for x in f.select("row_id", "row_seq", evaluate.match_key().alias("k1"), evaluate.match_key(False).alias("k2"), *(c.alias(f"by{i}") for i, c in enumerate(evaluate.content_steps()))).orderBy("row_seq", "row_id").collect()} for f in frames]
    want = set()
    for p, key in enumerate(("k1", "k2"), 1):
        for by in (f"by{i}" for i in range(5)):
            groups = {}
            for side, rows in enumerate(left):
                for i, x in rows.items():
                    if x[by] is not None:
                        groups.setdefault((x[key], x[by]), ([], []))[side].append(i)
            for g, e in (pair for both in groups.values() for pair in zip(*both)):
                want.add((g, e, p))
                del left[0][g], left[1][e]
    rest = [[(x[0], *x[2:6]) for x in sorted(rows, key=lambda x: (x[1], x[0])) if x[0] in left[k]] for k, rows in enumerate(sides)]
    want |= {(*x, 3) for x in any_account(*rest)}
    assert {x[2] for x in want} >= {1, 2}
    plans, write = [], evaluate.cut
    monkeypatch.setattr(evaluate, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    assert {tuple(x) for x in evaluate.match_rows(*frames).collect()} == want
    assert [p.split("Initial Plan")[-1].count("Exchange ") for p in plans[:3]] == [2, 1, 1]  # the frames of this test; each pass once
    assert {tuple(x) for x in evaluate.match_rows(*frames, together=20).collect()} == want  # by ranges


def test_picks_reach_rows(spark):
    merged = spark.createDataFrame([("1", "a", 5), (None, "b", 6), ("3", None, 7)], "k string, city string, n int")
    found = spark.createDataFrame([("c1", "1", "city", "a", "z", "d2"), ("c2", "1", "n", "5", "9", "d2"), ("c3", None, "city", "b", "y", "d1"), ("c4", "1", "city", "a", "q", "d1"), ("c5", "3", "city", "p", "q", "d1")], "conflict_id string, k string, field string, value_a string, value_b string, doc_b string")
    picks = spark.createDataFrame([("c1", "b"), ("c2", "B"), ("c3", "b"), ("c4", "a"), ("c5", None), ("zz", "b"), ("c1", "b")], "conflict_id string, pick string")
    got = merge.apply_picks(merged, found, picks, ["k"], ["city", "n"])
    assert got.columns == merged.columns and sorted(map(tuple, got.collect()), key=str) == sorted([("1", "z", 9), (None, "y", 6), ("3", None, 7)], key=str)


@pytest.mark.parametrize("least", [0.92, 0.8])
def test_near_values_lose_no_pair(spark, least):
    r = random.Random(int(least * 100))
    base = ["ethernet private line", "voice", "internet", "a", "ab", "managed wifi", "ääö x", "aaaaaaaaab", "x" * 40, "sip trunking 100"]

    def harmed(t):
        out = list(t)
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(out) + 1)
            out[i : i + r.randint(0, 1)] = r.choice(["", "e", "x", " ", "ä"])
        return "".join(out)

    values, words = sorted({harmed(r.choice(base)) for _ in range(120)}), sorted({harmed(b) for b in base * 4})
    got = normalize.near_values(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, _i int"), least)
    want = {(v, w, i) for v in values for i, w in enumerate(words) if v and w and difflib.SequenceMatcher(None, v, w).ratio() >= least}
    rows = [(x.value, x.word, x._i) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 50


def test_similar_hints_are_those_of_brute_force(spark):
    monkeypatch.setattr(feedback, "BLOCK_ROWS", 7)
    monkeypatch.setattr(feedback, "QUESTION_ROWS", 3)
    r = random.Random(8)
    vector = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, "a" if i % 3 else "b", f"f{i % 3}", None if i % 9 == 0 else f"w{i}", f"v{i % 2}", "EXTRACTION" if i % 5 else "MERGE", None if i % 11 == 0 else vector()) for i in range(90)]
    asked = [(i, "a" if i % 2 else "b", vector()) for i in range(11)] + [(50, "none", vector()), (51, "a", None), (52, "a", [0.0] * 4)]
    got = {(x.q_id, x.field_name, x.correct_value): (x.wrong_value, x.n) for x in feedback.similar_hints(
        spark.createDataFrame(rows, "corr_id int, carrier string, field_name string, extracted_value string, corrected_value string, root_cause string, embedding array<double>").repartition(3),
        spark.createDataFrame(asked, "q_id int, carrier string, embedding array<double>")).collect()}
    want = {}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    for q, carrier, v in asked:
        near = sorted((-round(sum(x * y for x, y in zip(v, e)) / size(v) / size(e), 6), i, f, w, c) for i, k, f, w, c, cause, e in rows if k == carrier and cause == "EXTRACTION" and e and v and size(e) and size(v))[:10]
        for f, c in {(n[2], n[4]) for n in near}:
            group = [n for n in near if (n[2], n[4]) == (f, c)]
            if len(group) >= 2:
                want[q, f, c] = (group[0][3] or "", len(group))
    assert got == want and len(want) > 20


def test_phone_service_types_of_rows_without_a_phone(spark):
    rules = normalize.Rules(usoc_service_type={"1MB": "Voice"}, derive_month_to_month=False, derive_billing_per_contract=False)
    rows = [(1, "614-555", None, "1MB"), (2, "(614)555", "", None), (3, "", None, None), (4, None, "Data", None), (5, "", None, "1MB")]
    df = spark.createDataFrame([(i, p, t, u, 1, i) for i, p, t, u in rows], "row_id int, phone_number string, service_type string, usoc string, doc_seq int, row_seq int").withColumn("charge_type", F.lit("MRC"))
    out = normalize.after_merge(df, rules, F.current_date())
    assert {r.row_id: r.service_type for r in out.select("row_id", "service_type").collect()} == {1: "Voice", 2: "Voice", 3: None, 4: "Data", 5: "Voice"}


def test_diagnostic_scores(spark):
    cases = [
        ("carrier_account_number", "614-1", "61412345", "CORRECT"), ("contract_number", "abc", "9", "CORRECT"), ("master_account", "12", "34", "WRONG"), ("city", "Ak", "akron", "PARTIAL"), ("city", "Akron ", "AKRON", "CORRECT"), ("city", "", None, "BOTH_EMPTY"), ("city", "n/a", None, "EXTRA"),
        ("phone_number", "555-0100", "6145550100", "CORRECT"), ("phone_number", "550100", "6145550100", "WRONG"), ("rate", "$1,000.004", "1000.01", "CORRECT"), ("rate", "1", "1.02", "WRONG"), ("quantity", "2.0", "2", "CORRECT"), ("quantity", "x", "2", "WRONG"), ("contract_begin_date", "3/5/1997", "1997-03-05", "CORRECT"), ("zip", None, "43215", "MISSING")]
    df = spark.createDataFrame([(i, e, g) for i, (_, e, g, _) in enumerate(cases)], "i int, e string, g string")
    for i, (field, _, _, want) in enumerate(cases):
        assert df.filter(F.col("i") == i).select(evaluate.diagnostic_compare(field, F.col("e"), F.col("g")).alias("s")).first().s == want, cases[i]
