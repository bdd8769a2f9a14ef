"""Structure repair, collocations and url rules against plain models; nulls, repeated rows, empty tables, clashing columns, forced large paths."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

SPACE = " \t\n\x0b\x0c\r"


# --- conversations ------------------------------------------------------------------------------------------------------

GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(roles, faults):
    """Cost, audit and written rows, from the last row back, with whole strings as weights."""
    after = None
    for i in range(len(roles), -1, -1):
        own = {}
        for q in range(4):
            ways = [(0, "", ())] if i == len(roles) and q in (0, 3) else []
            if i < len(roles):
                def go(label, paid, to, out):
                    c, labels, rest = after[to]
                    ways.append((c + paid, label + labels, out + rest))
                go("D", 4, q, ())
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    if (q, roles[i][:1]) in GRAMMAR:
                        go("K", more, GRAMMAR[q, roles[i][:1]], ((roles[i], i),))
                    for name in ("user", "assistant"):
                        if (q, name[0]) in GRAMMAR:
                            go("R", 3 + more, GRAMMAR[q, name[0]], ((name, i),))
            own[q] = min(ways, key=lambda w: w[:2], default=(10**9, "", ()))
        for _ in range(5):  # insertions before row i, as many as may help
            for (q, initial), to in GRAMMAR.items():
                if initial in "ua":
                    c, labels, rest = own[to]
                    own[q] = min(own[q], (c + 3, "I" + labels, (({"u": "user", "a": "assistant"}[initial], None), *rest)), key=lambda w: w[:2])
        after = own
    return after[0]


def every_way(roles, faults, most_inserted=2):
    """Cost and audit of the best of all edit sequences, each written out."""
    best = (10**9, "")
    runs = [r for k in range(most_inserted + 1) for r in itertools.product("ua", repeat=k)]
    rows = [[("D", 4, "")] + ([] if f in ("blank", "duplicate") else [("K", 3 * (f == "truncated"), r[:1] or "?"), *(("R", 3 + 3 * (f == "truncated"), n) for n in "ua")]) for r, f in zip(roles, faults)]
    for picks in itertools.product(*rows):
        for own in itertools.product(runs, repeat=len(rows) + 1):
            written = "".join("".join(run) + (picks[i][2] if i < len(picks) else "") for i, run in enumerate(own))
            if re.fullmatch("(s?(ua)+)?", written):
                labels = "".join("I" * len(run) + (picks[i][0] if i < len(picks) else "") for i, run in enumerate(own))
                best = min(best, (sum(p[1] for p in picks) + 3 * sum(map(len, own)), labels))
    return best


def test_every_short_conversation():
    from tallyforge.llm.structure_repair import BLANK, CUT, FINE, TWICE, symbol, whole

    codes = {"": FINE, "blank": BLANK, "duplicate": TWICE, "truncated": CUT}
    for n in range(3):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            for faults in itertools.product(["", "blank", "truncated"], repeat=n):
                cost, audit = whole(bytes(symbol(r, codes[f]) for r, f in zip(roles, faults)))
                assert (cost, audit) == every_way(roles, faults) == cheapest(roles, faults)[:2]


def plain_repair(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        own += [(turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, written = cheapest([r[1] for r in own], faults)
        turns = [r[0] for r in own if r[0] is not None]
        digest = hashlib.sha256("\n".join(f"{name}:{'' if i is None else own[i][2]}" for name, i in written).encode()).hexdigest()
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def conversations(n, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Hello there.", "No end", "Why?", " \t\n", "", None, "Yes!", "One. Two\n", "é…", "Hm. \x0b", " "]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 7)):
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn * 2, None, 3]), r.choice(roles[:4]) if r.random() < 0.7 else r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"Text {r.random()}."))
    return rows + rows[:5]


def repaired(spark, rows, **how):
    from tallyforge.llm.structure_repair import audited, damaged, repair_parts

    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, copies long, block string").repartition(3)
    got = audited(df, *repair_parts(damaged(df), **how)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def test_repair_is_the_cheapest(spark):
    rows = conversations(120, 1)
    assert repaired(spark, rows) == plain_repair(rows)


def test_repair_in_blocks(spark):
    rows = conversations(60, 2) + [(7, t, "user" if t % 3 else "assistant", f"Turn {t % 40}." if t % 5 else "same") for t in range(90)]
    assert repaired(spark, rows, most_rows=2, block_rows=2) == plain_repair(rows)


def test_repair_of_one_long_conversation(spark):
    """One conversation with nearly all rows, dealt to tasks, against the way of small ones; equal rows many times."""
    rows = [(1, t // 2, "user" if t % 2 else "assistant", f"Text {t % 700}." if t % 11 else "cut off") for t in range(4_000)] + [(1, 5, "user", "again and again.")] * 3_000 + [(2, 0, "user", "Hi.")]
    assert repaired(spark, rows) == repaired(spark, rows, most_rows=10**9, most_bytes=10**12)


def test_repaired_rows(spark):
    from tallyforge.llm.structure_repair import repair

    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "B.")], "conv_id long, turn long, role string, text string")
    (row,) = repair(df).collect()
    assert (row.audit, row.cost, row.roles, row.texts) == ("IKKDI", 10, ["user", "assistant", "user", "assistant"], ["", "A.", "B.", ""])
    assert repair(df.limit(0)).count() == 0


def test_repair_of_nothing(spark):
    assert repaired(spark, []) == {}
    gone = next(c for c in range(1_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- phrases ------------------------------------------------------------------------------------------------------------

def plain_phrases(rows, least, percent, top, most_words=5, scale=1000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, most_words + 1) for i in range(len(words) - k + 1))
    found = {g: n for g, n in counts.items() if n >= least and len(g) > 2}
    longest = {}
    for g, n in found.items():
        for m in range(2, len(g) - 1):
            for i in range(1, len(g) - m + 1):
                sub = (g[0], *g[i : i + m])
                longest[sub] = max(longest.get(sub, 0), n)
    by_lang = {}
    for g, a in found.items():
        if 100 * longest.get(g, 0) >= percent * a:
            continue
        cuts = [(scale * a * totals[g[0]] // (counts[g[: 1 + k]] * counts[(g[0], *g[1 + k :])]), k) for k in range(1, len(g) - 1)]
        score, k = min(cuts)
        by_lang.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), counts[g[: 1 + k]], counts[(g[0], *g[1 + k :])]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for lang, xs in by_lang.items() for i, x in enumerate(sorted(xs)[:top]))


def corpus(n, seed):
    r = random.Random(seed)
    words = ["a", "B", "c", "dé", "É", "f g", "h", "x\x00y", "of", "the", "The"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!?", "\x0b", ""]
    return [(r.choice(["en", "en", "en", "fr", None, "und", ""]), r.choice([None, "", " ", "."]) if r.random() < 0.1 else "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(1, 60)))) for _ in range(n)]


@pytest.mark.parametrize("bits", [4, 10, 24])
def test_phrases_are_counted_exactly(spark, bits):
    """A sketch of 16 cells lets everything through, a wide one little: the result is the same."""
    from tallyforge.llm.collocations import collocations

    rows = corpus(300, 3)
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "lang string, text string, n long, phrase string").repartition(3)
    for least, percent, top in ((4, 100, 2000), (3, 80, 7)):
        got = sorted(tuple(r) for r in collocations(df, least=least, percent=percent, top=top, bits=bits).collect())
        assert got == plain_phrases(rows, least, percent, top)
    assert collocations(df.limit(0), bits=bits).count() == 0


def test_sketch_leaves_the_rare_out(spark):
    from tallyforge.llm.collocations import frequent, sketch

    df = spark.createDataFrame([("en", f"often said w{i} w{i + 1}") for i in range(200)], "lang string, text string")
    bitmaps = sketch(df, 16, 5, 100)
    assert [sum(int(b).bit_count() for b in m) for m in bitmaps] == [3, 3]  # often, said, often said
    assert {(r.k, r.phrase, r.n) for r in frequent(df, bits=16).collect()} == {(0, "", 800), (1, "often", 200), (1, "said", 200), (2, "often said", 200)}


def test_full_bitmaps_are_not_filled_by_rare_phrases(spark):
    """Occurrences are 140 to a bit of either bitmap, yet only what is frequent is marked."""
    from tallyforge.llm.collocations import sketch

    df = spark.createDataFrame([("en", "often said " + " ".join(f"w{i}x{j}" for j in range(100))) for i in range(300)], "lang string, text string")
    assert [sum(int(b).bit_count() for b in m) for m in sketch(df, 10, 5, 100)] == [3, 3]  # often, said, often said


def test_cells_are_summed_over_runs(monkeypatch):
    from tallyforge.llm import collocations as C

    monkeypatch.setattr(C, "SUMMED", 50)  # blocks are summed up on the way, and several blocks at a time
    rng, want, rows = np.random.default_rng(5), Counter(), []
    for _ in range(30):
        cell = np.sort(rng.choice(np.concatenate([rng.integers(0, 1 << C.WIDE, 40), np.arange(300), [(1 << C.WIDE) - 1]]).astype(np.uint64), 200, replace=False))
        times = rng.integers(1, 1 << 23, 200)
        want.update(dict(zip(cell.tolist(), times.tolist())))
        for batch in C.packed(cell, times):
            rows += zip(*(c.to_pylist() for c in batch.columns))
    rows.sort(key=lambda r: r[0])
    batches = [C.pa.RecordBatch.from_arrays([C.pa.array([b for b, _ in rows[i : i + 7]], C.pa.int32()), C.pa.array([r for _, r in rows[i : i + 7]], C.pa.binary())], names=["block", "cells"]) for i in range(0, len(rows), 7)]
    for least in (1, 1 << 22, 100_000_000, 1 << 40):  # counts stop at MOST, and so does least
        on = np.array([k for k, n in want.items() if min(n, C.MOST) >= min(least, C.MOST)], np.uint64)
        got = [set(), set()]
        for batch in C._merged(20, least)(iter(batches)):
            for r, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                got[r] |= {b * C.BLOCK_BITS + x for x in np.frombuffer(raw, "<u4").tolist()}
        assert got == [set(x.tolist()) for x in C.places(on, 20)]


def test_products_beyond_64_bits(spark):
    text = " ".join(["new york"] * 3_000) + " . " + "x " * 5_000
    rows = [("en", text)] * 4
    from tallyforge.llm.collocations import collocations

    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in collocations(df, scale=10**12).collect()) == plain_phrases(rows, 100, 100, 2000, scale=10**12)


# --- urls ---------------------------------------------------------------------------------------------------------------

def plain_verdict(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


ODD_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/", "block"), ("a.example.net", "", "allow"), ("net", "/e", "allow"), ("org", "/very/deep/path/", "block"), ("org", "/very/deep/pa", "allow"), ("b.c.d.e.f", "/x.html", "block"), ("", "/zz/", "block")]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_urls(spark, monkeypatch, limit):
    from tallyforge.llm import url_filter

    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    r = random.Random(5)
    hosts = ["net", "example.net", "a.example.net", "x.a.Example.NET", "badexample.net", "org", "w.org", "b.c.d.e.f", "z.b.c.d.e.f", "user@a.net:80", "", "a..net", "net."]
    paths = ["", "/", "/en", "/en/", "/en/1", "/english", "/very/deep/path", "/very/deep/path/x", "/very/deep/pa", "/x.html", "/x.html/y", "//", "/zz/1", "/É/%20", "/" * 300]
    urls = [None, "", "no scheme", "://", "http:/a.net/", "HTTP://A.NET://b.org/", "\nhttp://net/\nx"] + [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=1', '#top', '?a#b', '/?x'])}" for _ in range(500)] + ["http://net/" + "d/" * 5_000]
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)] + [(1, urls[9])] * 3
    pages = spark.createDataFrame([(*x, "h", "s") for x in rows], "page_id long, url string, host string, site string").repartition(3)
    for rules in (ODD_RULES, url_filter.RULES, []):
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = sorted(map(repr, ((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(pages, table).collect())))
        plain = {(h, p): v for h, p, v in sorted(rules)}  # of equal ones, block is the greater
        assert got == sorted(repr((i, *plain_verdict(u, [(h, p, v) for (h, p), v in plain.items()], "allow"))) for i, u in rows)
        assert url_filter.judge_urls(pages.limit(0), table).count() == 0


def test_rules_with_nulls(spark):
    from tallyforge.llm.url_filter import judge_urls

    rules = spark.createDataFrame([("Net", None, "block"), (None, None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net"), (2, "http://a.org/x"), (3, None)], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).collect()} == {1: ("net", "block"), 2: (None, "allow"), 3: ("", "block")}


def test_queries_of_these(spark):
    from tallyforge.llm import queries as q

    made = {n: f for n, f in q.queries().items() if n.split("_")[0] in ("op11", "op12", "op13")}
    assert len(made) == 3
    d = "/root/testdata/sf0.001"
    conv = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = plain_repair([tuple(r) for r in conv])
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in made["op11_structure_repair"](spark, d).collect()}
    assert got == want
    docs = spark.read.parquet(f"{d}/documents.parquet").select("lang", "text").collect()
    assert sorted(tuple(r) for r in made["op12_phrase_collocations"](spark, d).collect()) == plain_phrases([tuple(r) for r in docs], 100, 100, 2000)
