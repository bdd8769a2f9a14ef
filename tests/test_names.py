"""Many names at once: the automaton, names against a registry, carriers of whole texts; kinds by file name."""

import contextlib
import io
import random
import re

from pyspark.sql import functions as F

from tallyforge.functions import automaton
from tallyforge.functions import text as X
from tallyforge.operators import classify


def test_automaton_counts_as_a_pattern_does():
    r = random.Random(1)
    words = ["at", "at&t", "&co", "acme", "acme acme", "éa", "a_b", "b", "ab ab"]
    for _ in range(300):
        text = "".join(r.choice([*words, " ", " ", "-", "_", "É", "1", "AT", "Acme"]) for _ in range(r.randint(0, 14)))
        patterns = [(i, w, i % 2 == 0) for i, w in enumerate(words)]
        want = {}
        for i, w, as_words in patterns:
            n = len(re.findall(rf"\b{re.escape(w)}\b" if as_words else re.escape(w), text.lower()))
            if n:
                want[i] = n
        got = automaton.count(automaton.build(patterns), text)
        assert {i: n for i, n in got.items() if not patterns[i][2]} == {i: n for i, n in want.items() if not patterns[i][2]}
        # A pattern engine goes on after a hit, so does this; both take the leftmost
        assert {i: n for i, n in got.items() if patterns[i][2]} == {i: n for i, n in want.items() if patterns[i][2]}


def test_occurrences_in_columns(spark, monkeypatch):
    monkeypatch.setattr(automaton, "MOST_CHARS", 5)  # several automata
    df = spark.createDataFrame([(1, "Alpha and ALPHA beta"), (2, None), (3, "")], "i int, text string")
    got = {r.i: [tuple(h) for h in r.h] for r in df.select("i", automaton.occurrences(spark, F.col("text"), [(0, "alpha", True), (1, "Beta", False), (2, "gamma", True), (3, "", True)]).alias("h")).collect()}
    assert got == {1: [(0, 2), (1, 1)], 2: [], 3: []}
    assert df.select(automaton.occurrences(spark, F.col("text"), []).alias("h")).first().h == []


def plain_match(name, registry):
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    n, best = key(name), None
    for pos, (slug, display, aliases) in enumerate(registry):
        for a in map(key, [display, *aliases]):
            if not a or not n:
                continue
            turn = (1, 0) if a == n else (2, -len(a)) if len(a) >= 3 and a in n else (3, 0) if len(n) >= 3 and n in a else None
            if turn and (best is None or (turn, pos) < best[0]):
                best = ((turn, pos), display, slug)
    return (best[1], best[2]) if best else (name.strip(), None)


def test_names_against_many_aliases(spark):
    r = random.Random(2)
    syllables = ["tel", "com", "net", "at", "wave", "ion", "x", "line", "fi", "ber"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4))).capitalize()
    registry = [(f"c{i}", f"{word()} {word()}", [word() for _ in range(r.randint(0, 3))]) for i in range(3_000)]
    names = [f"{word()} {r.choice(['', word(), 'Inc.', '&'])}" for _ in range(150)] + ["", "&", "at", "Zq", "zqzq"]
    reg = spark.createDataFrame([(k, d, a, i) for i, (k, d, a) in enumerate(registry)], "key string, display string, aliases array<string>, position int")
    out = classify.match_names(spark.createDataFrame([(n,) for n in [*names, *names[:5]]], "name string"), reg)
    assert sorted((x.name, x.canonical, x.carrier_key) for x in out.collect()) == sorted((n, *plain_match(n, registry)) for n in [*names, *names[:5]])
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain("formatted")
    assert "NestedLoop" not in plan.getvalue() and "Cartesian" not in plan.getvalue()


def test_deep_scan_of_many_carriers(spark):
    registry = [(f"k{i}", f"carrier number {i}", [f"alias{i}", "abc"], [r"\d{3}-\d{4}"] if i == 7 else []) for i in range(2_000)]
    files = spark.createDataFrame([(1, "Carrier Number 12 and alias12, alias13x"), (2, "ALIAS7 555-1234 555-1235 alias8"), (3, "alias5 alias6"), (4, None), (5, "xalias9")], "i int, text string")
    got = {r.i: (r.carrier, r.points, r.runner_up) for r in classify.deep_scan(files, registry).collect()}
    assert got == {1: (None, 15, 10), 2: (None, 9, 5), 3: (None, 5, 5), 4: (None, 0, 0), 5: (None, 0, 0)}  # "carrier number 1" is in the first, too
    assert classify.deep_scan(files, registry[7:8]).filter("i = 2").first().carrier == "k7"
    assert classify.deep_scan(files, []).count() == 5


def test_kinds_of_names(spark):
    names = {"ACME_CSR2.pdf": "csr", "csrs.pdf": None, "x.eml": "email", "My-Order Form.pdf": "contract", "bill.pdf": "invoice", "billy.pdf": None, "mybill.pdf": None, "spend.summary.xlsx": "report", "TN1 list.csv": "did_list", "billing statement": "invoice", "plan_details": "subscription", "contract bill": "contract"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.t for r in df.select("n", X.document_type(F.col("n")).alias("t")).collect()} == names
