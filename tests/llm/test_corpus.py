"""Each corpus operator against a brute-force version, on a table with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

random.seed(5)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["an", "er", "the", "ou", "st", "ré", "ß", "tion", "qu", "ing"]


def sentence(n):
    return " ".join("".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 4))) for _ in range(n))


PASSAGE = sentence(90)
BASE = sentence(200).split()
TEST = sentence(40)


def near(k):
    w = list(BASE)
    for i in range(k):
        w[(i * 37) % 200] = "changed"
    return " ".join(w)


def rows():
    texts = [None, "", " \n\t", "one", "Two Words", "a" * 3_000, sentence(30_000), near(0), near(0).upper(), near(1), near(2), near(6), near(30), "!!! ### $$$ " * 40, "Same Same " * 80]
    texts += [sentence(random.randint(5, 300)) for _ in range(25)]
    texts += [sentence(40) + " " + PASSAGE + " " + sentence(30) for _ in range(5)] + [PASSAGE, PASSAGE[:380]]
    texts += [sentence(20) + " " + TEST + " " + sentence(20), " ".join(TEST.split()[3:16]), TEST.upper() + "."]
    texts += ["İstanbul ΣΑΣ 日本語 ﬁ é <|endoftext|> don't  x"]
    return [(i, t, "xx", float(i)) for i, t in enumerate(texts)]


ROWS = rows()
#: Other columns have names that the operators use within.
SCHEMA = "doc_id long, text string, key string, rank double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A repeated row and a row without an id."""
    return spark.createDataFrame([*ROWS[:10], ROWS[9], (None, "no id here", "", 0.0)], SCHEMA)


def encoded(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x, *_ in ROWS}


def test_packing(docs, none, odd):
    from tallyforge.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    out = pack_documents(docs, path).collect()
    ids = encoded("word_bpe_49k.json")
    by = defaultdict(list)
    for r in out:
        v = np.array(ids[r.doc_id], "<u4")[r.start : r.start + r.length]
        assert r.start == r.piece * 2048 and zlib.crc32(v) == r.ids_crc32 and len(v) == r.length
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(map(len, ids.values())) // 2048) + 1
    assert pack_documents(none, path).count() == 0 and pack_documents(odd, path).count() >= 12


def test_plan_is_best_fit():
    from tallyforge.llm.packing import plan

    counts = {n: random.randint(1, 9) for n in random.sample(range(1, 101), 40)}
    slots, total = plan(counts, 100)
    used = defaultdict(int)
    for length, a, b, first, times, _ in slots:
        for k in range(a, b):
            used[first + (k - a) // times] += length
    assert max(used.values()) <= 100 and len(used) == total
    free = []  # best-fit decreasing, item by item
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(100 - n)
    assert total <= len(free)


def test_decontamination(spark, docs, none, odd, monkeypatch):
    from tallyforge.llm import decontaminate
    from tallyforge.llm.decontaminate import contamination, keep_clean, longest_matches

    items = [(0, TEST), (1, "Only four plain words"), (2, None), (3, ""), (4, TEST), (5, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = defaultdict(set)
    for i, t in items:
        w = find((t or "").translate(LOW))
        for a in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[a : a + 13])].add(str(i))
    whole = contamination(docs, bench)
    got = {r.doc_id: r for r in whole.collect()}
    for i, t, *_ in ROWS:
        w = find((t or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    found |= windows[tuple(w[a : a + n])]
                    hit[a : a + n] = [1] * n
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), sum(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (sum(hit) > 0 and 20 * sum(hit) >= len(w))
        long = 0  # the longest run of words that stands in an item, too
        for _, t in items:
            v = find((t or "").translate(LOW))
            for a in range(len(v)):
                for b in range(len(w)):
                    m = 0
                    while a + m < len(v) and b + m < len(w) and v[a + m] == w[b + m]:
                        m += 1
                    long = max(long, m if m >= min(13, len(v)) else 0)
            if len(w) > 2_000:
                break
        assert r.longest == long or len(w) > 2_000
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert max(r.n_words for r in longest_matches(docs, bench).collect()) == 40
    assert contamination(none, bench).count() == 0 and contamination(odd, bench).count() == 12
    assert contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    same = spark.createDataFrame([(1, TEST), (1, "One"), (None, TEST), (None, "one")], "item_id long, text string")  # equal ids, and none
    got = {r.doc_id: r for r in contamination(docs, same).filter("n_hit > 0").collect()}
    assert {(r.n_items, r.items_sha256) for r in got.values()} == {(2, hashlib.sha256(b"1").hexdigest())}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1)  # a block for each item
    assert contamination(docs, bench).exceptAll(whole).count() == 0


def test_benchmark_blocks_grow_with_the_text_alone(spark):
    import pickle

    from tallyforge.llm.decontaminate import build_block, contamination, longest_matches

    words = [f"w{k}" for k in range(20_000)]
    assert len(pickle.dumps(build_block([(0, " ".join(words))]))) < 2e6  # a row of words for each suffix would be 3.2 GB
    text = " ".join(words)
    docs = spark.createDataFrame([(0, "before " + " ".join(words[100:19_000]) + " after"), (1, " ".join(words[500:600])), (2, "w1 w2 w3")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (8, " ".join(words[:14])), (9, text[:60])], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs, bench).collect()}
    assert (got[0].n_hit, got[0].n_items, got[1].n_hit, got[1].n_items, got[2].n_hit) == (18_900, 1, 100, 1, 0)
    best = {(r.item_id, r.start): (r.n_words, r.doc_id, r.word) for r in longest_matches(docs, bench).collect()}
    assert best["7", 100] == (18_900, 0, 1) and best["7", 590] == (18_410, 0, 491) and ("7", 99) not in best and ("8", 0) not in best
    assert build_block([(0, None), (1, ""), (2, "a")]).alone.tolist() == [1]


def test_longest_matches_of_repeated_words(spark):
    """Few words, repeated: every suffix of every item against every place of every document."""
    import random

    from tallyforge.llm.decontaminate import contamination, longest_matches

    rng = random.Random(11)
    text = lambda most, kinds: " ".join(rng.choice("abcd"[:kinds]) for _ in range(rng.randrange(most)))
    docs = [(rng.randrange(40), text(60, rng.choice([1, 2, 2, 4]))) for _ in range(60)] + [(None, "a " * 30), (99, None)]
    docs = list(dict(docs).items())  # an id each
    items = [(i, text(rng.choice([4, 12, 40]), rng.choice([1, 2, 4]))) for i in range(40)] + [(40, "a " * 25), (41, ""), (42, None), (43, "a " * 25)]
    least = 5
    common = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    want, longest, found = {}, dict.fromkeys((d for d, _ in docs), 0), {d: set() for d, _ in docs}
    for i, t in items:
        w = (t or "").split()
        for start in range(max(len(w) - least + 1, 1) if w else 0):
            for d, u in docs:
                v = (u or "").split()
                for at in range(len(v)):
                    n = common(w[start:], v[at:])
                    if n >= min(least, len(w)):
                        longest[d], found[d] = max(longest[d], n), found[d] | {i}
                        best = (-n, -1 if d is None else d, at)
                        want[str(i), start] = min(want.get((str(i), start), best), best)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.start): (-r.n_words, -1 if r.doc_id is None else r.doc_id, r.word) for r in longest_matches(d.coalesce(1), b, least).collect()}
    assert got == want and len(want) > 200
    assert {(r.item_id, r.start): (-r.n_words, -1 if r.doc_id is None else r.doc_id, r.word) for r in longest_matches(d.repartition(5), b, least).collect()} == want
    rows = contamination(d, b, least).collect()
    assert {r.doc_id: (r.longest, r.n_items) for r in rows} == {i: (longest[i], len(found[i])) for i, _ in docs}


def test_one_word_repeated_is_linear():
    """10,000 equal words against a text of a million of them: 10^10 pairs of places, none of them listed."""
    import time
    import tracemalloc

    import numpy as np

    from tallyforge.llm.decontaminate import Joint, build_block, find, words

    block, n = build_block([(1, "word " * 10_000)]), 1_000_000
    hashes, bounds = np.repeat(words(np.frombuffer(b"word", np.uint8), np.array([0, 4]))[0], n), np.array([0, n])
    tracemalloc.start()
    begun = time.time()
    f = find(hashes, bounds, block)
    at, length = Joint(f, block, 13).of_text()
    assert len(f.at) == len(at) == n - 12 and len(f.sets) == 1 and length.max() == 10_000 and length.min() == 13
    assert tracemalloc.get_traced_memory()[1] < 600e6 and time.time() - begun < 60
    tracemalloc.stop()


def plain_sets(k):
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    out = {}
    for i, t, *_ in ROWS:
        w = find((t or "").translate(LOW))
        out[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, odd, k, percent):
    from tallyforge.llm.minmax_dedup import keep_one, near_duplicates

    sets = plain_sets(k)
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if a != b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r for r in near_duplicates(docs, k, percent).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert {r.doc_id for r in keep_one(docs, k, percent).collect()} == {i for i in sets if label[i] == i}
    if k == 3:
        assert near_duplicates(none, k, percent).count() == 0 and near_duplicates(odd, k, percent).count() == 12


def test_difference_sets_decide_like_full_sets(spark):
    """Members that their leader isn't linked with, against all pairs."""
    from tallyforge.llm.minmax_dedup import near_duplicates

    data = []
    for i in range(40):
        w = list(BASE[:120])
        for _ in range(random.randint(0, 7)):
            w[random.randrange(120)] = random.choice(["x", "y", "z"])
        data.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[a : a + 3]) for a in range(118)} for i, t in data}
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_jpeg_payloads(docs, none):
    from tallyforge.llm.media_jpeg import Picture, decode_media, encode_payload, encode_text, read_payload, text_media

    for r in text_media(docs).collect():
        data = (ROWS[r.doc_id][1] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert text_media(none).count() == 0
    shown = decode_media(encode_text(docs.filter("doc_id < 5"))).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in shown)

    class Slow(Picture):
        def _uniform(self, *a):
            return False

    raw = encode_payload(random.randbytes(1_000))
    assert read_payload(Slow(raw)) == read_payload(Picture(raw)) and (Slow(raw).rgb() == Picture(raw).rgb()).all()


def test_inverse_transform_of_a_flat_block():
    from tallyforge.llm.media_jpeg import _INVERSE

    assert np.allclose(np.eye(64)[0] @ _INVERSE / 2**24, 1 / 8, atol=1e-3)


def test_separator_scan(docs, none):
    from tallyforge.llm.token_counts import documents_round_trip, scan

    ids = encoded("word_bpe_49k.json")
    got = sorted(documents_round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) for i, x in ids.items()}
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert documents_round_trip(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    v = np.array([5, 0, 6, 7, 8, 9, 0, 0, 3])
    for block in (1, 2, 3, 100):
        ends, first = scan(v, 0, block)
        assert ends.tolist() == [1, 6, 7] and first.tolist() == [-1, 2, 7]


@pytest.mark.parametrize("wide", [1_024, 3, 0])  # passes by bucket, and place by place
def test_suffix_arrays(wide, monkeypatch):
    from tallyforge.llm import induced
    from tallyforge.llm.induced import common_prefixes, suffix_array

    monkeypatch.setattr(induced, "WIDE", wide)
    for n in range(1, 200):
        s = np.random.default_rng(n).integers(0, 1 + n % 5, n)
        s = np.tile(s[:7], 30)[:n] if n % 3 == 0 else s
        sa = suffix_array(s, int(s.max()) + 1)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        plcp, v = common_prefixes(s, sa), s.tolist()
        for a, b in zip(sa, sa[1:]):
            m = next((k for k in range(n) if max(a, b) + k >= n or v[a + k] != v[b + k]), n)
            assert plcp[b] == m


def plain_losses(texts, n):
    """n_removed, n_spans, kept bytes of each text: strings of n bytes that start more than once."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        out.append((int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def held_against_plain(spark, rows, length=400, both=False):
    from tallyforge.llm.suffix_dedup import PASSAGE as LONG, SHARED, losses, suffix_dedup

    texts = [t for _, t in rows]
    plain = plain_losses(texts, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(i), len((t or "").encode()), *a[:2], hashlib.sha256(a[2]).hexdigest()) for (i, t), a in zip(rows, plain))
    got = suffix_dedup(docs, length).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    where = [defaultdict(set) for _ in range(2)]
    for k, n in enumerate((LONG, SHARED)):
        for i, t in rows:
            b = (t or "").encode()
            for at in range(len(b) - n + 1):
                where[k][b[at : at + n]].add((i, t))
    shared = [Counter((str(i), len((t or "").encode())) for v in w.values() if len(v) > 1 for i, t in v) for w in where]
    for r in got:  # none where nothing is shared, some where a passage is
        key = str(r.doc_id), r.n_bytes
        assert (r.n_shared > 0) >= (shared[0][key] > 0) and (r.n_shared > 0) <= (shared[1][key] > 0)
    if not both:
        return
    two = losses(docs, (240, length))  # both lengths at once
    assert two.agg({"n_removed": "sum"}).first()[0] == losses(docs, (length,)).agg({"n_removed": "sum"}).first()[0]
    size = {(str(i), a[0]) for (i, _), a in zip(rows, plain_losses(texts, 240)) if a[0] and i is not None}
    assert {(str(r.id), r.n_repeated) for r in two.collect()} >= size


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2_000])
def test_repeated_passages(spark, none, shard_bytes, monkeypatch):
    from tallyforge.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)  # where groups are too large, they are dealt by more and more bytes
    cut = [(100 + k, PASSAGE[: 230 + 10 * k]) for k in range(20)] + [(200 + k, PASSAGE[k : 300 + 9 * k]) for k in range(15)]
    whole = shard_bytes == 1 << 20
    held_against_plain(spark, [(i, t) for i, t, *_ in ROWS if whole or i > 6] + cut, both=whole)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_repeated_passages_of_odd_rows(spark):
    """Repeated rows, rows without an id, and rows that share one."""
    x, y, z = sentence(40), sentence(40), sentence(40)
    held_against_plain(spark, [(1, x + PASSAGE), (None, PASSAGE + y), (None, z), (2, x + y), (2, z + PASSAGE[9:] + y), (3, y), (3, y), (4, None), (4, ""), (None, None)])


def test_large_groups_are_dealt_to_the_end(spark, monkeypatch):
    """A common string of 300 bytes among hundreds of different neighbours, and one of 500."""
    from tallyforge.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3_000)
    rows = [(i, sentence(random.randint(0, 40)) + PASSAGE[:300] + sentence(random.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, sentence(random.randint(0, 30)) + PASSAGE[:500] + sentence(random.randint(0, 30))) for i in range(40)]
    held_against_plain(spark, rows)


def test_without_repeats_keeps_other_columns(spark):
    from tallyforge.llm.suffix_dedup import without_repeats

    rows = [(1, "a" * 20 + PASSAGE, "k", 1.0), (None, PASSAGE, "l", 2.0), (2, PASSAGE + "é" * 9, "m", 3.0), (3, None, None, None), (4, "", "", 0.0), (4, "short", "n", None), (4, "short", "n", None)]
    docs = spark.createDataFrame(rows, "id long, text string, mark string, kept double").selectExpr("id as doc_id", "text", "mark", "kept", "1 as id")
    got = without_repeats(docs, 240)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text, r.mark, r.kept) for r in got.collect() if r.text is not None) == sorted([("1", "a" * 20, "k", 1.0), ("2", "é" * 9, "m", 3.0), ("4", "", "", 0.0), ("4", "short", "n", None), ("4", "short", "n", None)], key=str)
    assert got.filter("text is null").count() == 1 and without_repeats(docs.limit(0), 240).count() == 0


def test_sharding(docs, none, odd):
    from tallyforge.llm.sharding import shard_documents, smallest

    got = shard_documents(docs, 6).collect()
    sizes, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        t = ROWS[r.doc_id][1]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        texts[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in texts.values())
    assert shard_documents(none, 6).count() == 0 and shard_documents(odd, 6).count() == 12
    for _ in range(50):
        v = [random.randint(1, 20) for _ in range(12)]
        best = min(max(sum(v[a:b]) for a, b in zip([0, *c], [*c, 12])) for c in ([i, j] for i in range(13) for j in range(i, 13)))
        assert smallest(v, 3)[0] == best


def test_cuts_are_those_over_single_groups(spark):
    from tallyforge.llm import sharding

    keys = [(random.getrandbits(63) >> random.choice([0, 0, 40]), random.randint(1, 1_000)) for _ in range(3_000)] + [(1 << 62, 90_000)]
    total = Counter()
    for k, s in keys:
        total[k] += s
    order = sorted(total)
    cuts, capacity = sharding.cut_keys(spark.createDataFrame(keys, "key long, size long"), 8)
    assert capacity == sharding.smallest([total[k] for k in order], 8)[0]


def test_quality(spark, docs, none):
    from tallyforge.llm.quality import keep_good, quality_scores

    data = [(i, sentence(random.randint(20, 200)) + ".", None) for i in range(200)] + [(200 + i, " ".join(w.upper() + "!!" for w in sentence(60).split()), None) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, *_ in data if i % 2] + [(None, 1), (9_999, 0)], "doc_id long, quality int")
    known = spark.createDataFrame(data, "doc_id long, text string, features string")
    got = quality_scores(known, labels).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id < 200) for r in held]) > 0.95
    assert {r.doc_id for r in keep_good(known, labels).collect()} == {r.doc_id for r in got if r.predicted}
    assert quality_scores(docs, labels).count() == len(ROWS) and quality_scores(none, labels).count() == 0


def test_language_model(docs, none, odd):
    from tallyforge.llm import attention_lm

    path = public_tokenizers.path("word_bpe_49k.json")
    find = re.compile(r"[^\x20\x09-\x0D]+").findall

    def against(table, rows):
        tokens = [(i, [*find((t or "").translate(LOW)), None]) for i, t in rows]
        count = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
        n, v = sum(count.values()), len(count)
        got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in attention_lm.score_documents(table, path).collect()), key=lambda r: (r[0], r[1] or 0))
        assert len(got) == len(tokens)
        for r, (i, ws) in zip(got, sorted(tokens, key=lambda x: (x[0] is None, x[0] or 0))):
            base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert r[1:5] == (i, len(ws), sum(count[w] > 0 for w in ws), n)
            assert abs(r[5] - base) < 1e-6 * abs(base) and r[6] < 0
        return got

    against(docs, [(i, t) for i, t, *_ in ROWS])
    assert attention_lm.score_documents(none, path).count() == 0
    got = against(odd, [(i, t) for i, t, *_ in ROWS[:10]] + [(ROWS[9][0], ROWS[9][1]), (None, "no id here")])
    assert len({r[5:] for r in got if r[1] == ROWS[9][0]}) == 1  # repeated rows


def small_model(size=40, seed=3):
    """A model of counted texts with random weights, the texts, and plain counts."""
    from tallyforge.llm import attention_lm as A

    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, size - 1, n) for n in (0, 1, 2, 5, A.STRIDE - 1, A.STRIDE, 70, 200)]
    texts.append(np.concatenate([texts[6], texts[6]]))
    grams = [Counter() for _ in range(3)]
    for t in texts:
        s = [size - 1, size - 1, *t.tolist(), size - 1]
        for i in range(2, len(s)):
            for n in range(3):
                grams[n][tuple(s[i - n : i + 1])] += 1
    coded = [(np.array([np.polyval(k, size) for k in g], np.int64), np.array(list(g.values()), np.float64)) for g in grams[1:]]
    counts = np.array([grams[0][(i,)] for i in range(size)], np.float64)
    made = A.Ngrams(counts, *coded)
    assert (made.two.keys >= 0).sum() == len(grams[1]) and (made.three.keys >= 0).sum() == len(grams[2])  # no two keys meet
    w = {n: x + rng.standard_normal(x.shape).astype(np.float32) * np.float32(0.2) for n, x in A.first_weights().items()}
    w["near"] += 3
    return A.Model(w, made, A.reads_of(counts)), texts, grams


def test_language_model_is_a_plain_forward_pass():
    from tallyforge.llm import attention_lm as A

    model, texts, (one, two, three) = small_model()
    w, size = model.weights, model.grams.size
    followers2, followers3 = Counter(k[0] for k in two), Counter(k[:2] for k in three)

    def share(a, b, x):
        p = (one[(x,)] + 0.5) / (sum(one.values()) + 0.5 * size)
        held = sum(n for k, n in two.items() if k[0] == b)
        seen, kinds = max(one[(b,)], held), max(followers2[b], 1) * A.PAIR_SHARE
        p = (two[b, x] + (seen - held + kinds) * p) / (seen + kinds)
        held = sum(n for k, n in three.items() if k[:2] == (a, b))
        seen = max(two[a, b], held)
        if seen:
            kinds = max(followers3[a, b], 1) * A.TRIPLE_SHARE
            p = (three[a, b, x] + (seen - held + kinds) * p) / (seen + kinds)
        return p, np.log1p(seen)

    for text, got in zip(texts, model.scores(texts)):
        s, t, total = [size - 1, size - 1, *text.tolist()], [*text.tolist(), size - 1], 0.0
        for i, x in enumerate(t):
            p, seen = share(s[i], s[i + 1], x)
            r = model.reads[s[i + 1]]
            votes = [(t[j], np.exp(w["q"][r] @ w["k"][model.reads[s[j + 1]]] + w["near"][i - j - 1])) for j in range(max(0, i // A.STRIDE * A.STRIDE - A.BACK), i)]
            gate = np.exp(w["gate"][r] + w["seen"][0] * seen)
            total += np.log((gate * p + sum(v for y, v in votes if y == x)) / (gate + sum(v for _, v in votes)))
        assert abs(got - total) < 1e-4 * abs(total) + 1e-4


def test_language_model_probabilities_sum_to_one():
    from tallyforge.llm import attention_lm as A

    model, texts, _ = small_model()
    for before in ([], [3], list(texts[6][:40])):
        total = 0.0
        for x in range(model.grams.size):
            text = np.array([*before, x] if x < model.grams.size - 1 else before, np.int64)
            total += np.exp(np.concatenate([A.log_probabilities(model.weights, p).ravel() for p in A.windows([text], model.grams, model.reads, 0)])[len(before)])
        assert abs(total - 1) < 1e-4
    model, texts, _ = small_model()
    model.grams = A.Ngrams(np.zeros(40), *[(np.zeros(0, np.int64), np.zeros(0))] * 2)  # nothing to learn from
    assert abs(model.scores([np.zeros(0, np.int64)])[0] - np.log(1 / 40)) < 1e-5


def test_language_model_gradient():
    from tallyforge.llm import attention_lm as A

    model, texts, _ = small_model()
    w = {n: x.astype(np.float64) for n, x in model.weights.items()}
    x = A.joined(list(A.windows(texts, model.grams, model.reads, 1)))
    zeros = lambda: {n: np.zeros(s) for n, s in A.SHAPES.items()}
    _, grad = A.loss_and_gradient(w, x, zeros())
    for n in w:
        i = np.unravel_index(np.abs(grad[n]).argmax(), grad[n].shape)
        side = []
        for e in (1e-5, -2e-5):
            w[n][i] += e
            side.append(A.loss_and_gradient(w, x, zeros())[0])
        w[n][i] += 1e-5
        assert abs((side[0] - side[1]) / 2e-5 - grad[n][i]) < 1e-6 + 1e-3 * abs(grad[n][i])
    learned, n = A.learn(model.weights, [x], 0)
    assert n == len(x) and A.loss_and_gradient(learned, x)[0] < A.loss_and_gradient(model.weights, x)[0]


def test_language_model_trains_on_all_text(monkeypatch):
    from tallyforge.llm import attention_lm as A

    monkeypatch.setattr(A, "PIECE", A.STRIDE * 10)  # texts longer than a piece keep their history
    model, texts, _ = small_model()
    texts = [*texts, np.arange(35).repeat(40)]
    predicted = Counter()
    for turn in range(A.ROUNDS):
        for x in A.windows(texts, model.grams, model.reads, 1, turn, A.ROUNDS):
            for text, follows in zip(x.text.tolist(), x.follows[:, A.BACK :]):
                predicted.update((text, y) for y in follows.tolist() if y >= 0)
    assert predicted == Counter((k, y) for k, t in enumerate(texts) for y in [*t.tolist(), model.grams.size - 1])
    whole = model.scores(texts)
    monkeypatch.undo()
    assert np.allclose(whole, model.scores(texts), rtol=1e-5)
    x = A.joined(list(A.windows(texts, model.grams, model.reads, 1)))
    for n in (0, 1, A.BATCH, A.STEPS * A.BATCH, A.STEPS * A.BATCH + 5_000):  # few windows in whole passes, many of them once
        many = A.Windows(np.zeros((n, 1), np.int16), np.arange(n)[:, None], *[np.zeros((n, 1))] * 2, np.zeros(n, np.int64))
        got = Counter(y for b in A._enough(iter([many.take(slice(a, a + 999)) for a in range(0, n, 999)]), 0) for y in b.follows[:, 0].tolist())
        assert len(got) == n and len(set(got.values())) <= 1 and (n <= A.STEPS * A.BATCH or set(got.values()) == {1})
    assert len(x)


def test_language_model_is_sent_without_empty_slots():
    import pickle

    model, texts, _ = small_model()
    sent = pickle.dumps((model.grams, model.reads))
    assert len(sent) < 100_000  # a broadcast is written by the driver and by each executor
    got = pickle.loads(sent)[0]
    assert np.array_equal(got.two.rows, model.grams.two.rows) and np.array_equal(got.three.rows, model.grams.three.rows)
    want = model.scores(texts)
    model.grams = got
    assert np.array_equal(model.scores(texts), want)


def test_language_model_averages_in_a_tree(spark):
    from tallyforge.llm import attention_lm as A

    rows = [(k, k % 3 + 1, np.full(4, k, "<f4").tobytes()) for k in range(300)]
    mean = A.averaged(spark.createDataFrame(rows, "part int, n long, weights binary").repartition(7))
    assert np.allclose(mean, sum(k * n for k, n, _ in rows) / sum(n for _, n, _ in rows), rtol=1e-5)
    texts = [np.random.default_rng(k).integers(0, 30, k * 7) for k in range(30)]
    rows = spark.createDataFrame([(k, k % 5 == 1, t.astype("<u2").tobytes()) for k, t in enumerate(texts)], "doc_id long, held_out boolean, ids binary").repartition(3)
    want = [Counter() for _ in range(3)]
    for k, t in enumerate(texts):
        s = [99, 99, *t.tolist(), 99]
        for i in range(2, len(s) if k % 5 != 1 else 0):
            for n in range(3):
                want[n][int(np.polyval(s[i - n : i + 1], 100))] += 1
    packed = A.ngram_counts(rows, 100, "<u2", 4, piece=500)
    for n in range(3):
        codes, times = A.most_frequent_packed(packed, n + 1, 10**6)
        assert dict(zip(codes.tolist(), times.tolist())) == want[n]
    n = np.array([1] * 50 + [2] * 20 + [1_000] * 5)
    assert {m: int(A.most_of(n, m).sum()) for m in (3, 5, 24, 25, 74, 75)} == {3: 0, 5: 5, 24: 5, 25: 25, 74: 25, 75: 75}
    assert len(A.most_frequent_packed(packed, 2, 50)[0]) <= 50 and len(A.most_frequent_packed(packed.limit(0), 2, 50)[0]) == 0
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [1_000] * 5)], "h long, n long")
    assert {m: A.most_frequent(counts, "n", m).count() for m in (3, 5, 24, 25, 74, 75)} == {3: 0, 5: 5, 24: 5, 25: 25, 74: 25, 75: 75}


def test_language_model_uses_all_ngrams(spark, docs, monkeypatch):
    """Scores don't depend on how many n-grams a table would hold."""
    from tallyforge.llm import attention_lm as A

    path, scores = public_tokenizers.path("word_bpe_49k.json"), []
    for most in (8, 1 << 20):
        monkeypatch.setattr(A, "PAIRS", most)
        monkeypatch.setattr(A, "TRIPLES", most)
        scores.append(sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 3)) for r in A.score_documents(docs, path).collect()))
    assert scores[0] == scores[1]


def test_language_model_places_whole_counts(spark, monkeypatch):
    from tallyforge.llm import attention_lm as A

    x, size = np.random.default_rng(2).integers(0, 30, 500), 40
    table = A._numbered_contexts(x[:-1] * size + x[1:], x[1:], size)
    monkeypatch.setattr(A, "PAIR_CELLS", 0)
    assert all(np.array_equal(g, v) for g, v in zip(table, A._numbered_contexts(x[:-1] * size + x[1:], x[1:], size)))
    monkeypatch.undo()
    rng, size, made, want = np.random.default_rng(11), 40, [], [Counter() for _ in range(3)]
    for piece in range(12):
        texts = [rng.integers(0, 8 if piece % 2 else size - 1, n) for n in rng.integers(0, 60, 1 + piece)]
        held = [bool(rng.random() < 0.3) for _ in texts]
        made.append((piece, list(range(len(texts))), held, [0] * len(texts), [0] * len(texts), [0.0] * len(texts), [len(t) for t in texts], A.packed_ids(np.concatenate(texts), "<u2")))
        for t in (t for t, h in zip(texts, held) if not h):
            s = [size - 1, size - 1, *t.tolist(), size - 1]
            for i in range(2, len(s)):
                for n in range(3):
                    want[n][tuple(s[i - n : i + 1])] += 1
    seen, followers = Counter(), Counter(k[:2] for k in want[2])
    for k, n in want[2].items():
        seen[k[:2]] += n
    table = A.placed(spark.createDataFrame(made, A.DOCS).repartition(3), size, "<u2", 5).cache()
    shares = A.statistics(table, size, "<u2")
    assert shares.counts.tolist() == [want[0][(k,)] for k in range(size)] and shares.last.tolist() == [want[1][k, size - 1] for k in range(size)]
    assert shares.kinds.tolist() == [max(1, sum(k[0] == b for k in want[1])) for b in range(size)]
    coded = [(np.array([np.polyval(k, size) for k in g], np.int64), np.array(list(g.values()), np.float64)) for g in want[1:]]
    tables = A.Ngrams(shares.counts.astype(np.float64), *coded)  # where no two keys meet they say the same
    rows = table.collect()
    assert sorted(r.piece for r in rows) == list(range(12)) and all(tuple(r)[:8] in made for r in rows)
    for r in rows:
        ids, lens = next(A._texts(A.pa.array([bytes(r.ids)]), "<u2")), np.array(r.lens)
        values = A.values_of(ids, lens, size, bytes(r.triples), bytes(r.seen))
        texts, said = A._split(ids, lens, shares(ids, lens, values, 0))
        whole = iter(values.T.tolist())
        for t, (p, _) in zip(texts, said):
            s = [size - 1, size - 1, *t.tolist(), size - 1]
            for i in range(2, len(s)):
                assert next(whole) == [want[2][tuple(s[i - 2 : i + 1])], seen[tuple(s[i - 2 : i])], followers[tuple(s[i - 2 : i])]]
            assert np.allclose(p[1:], tables(np.array([s]))[0][0][1:], rtol=1e-5)  # tables hold no pair of ends, which begins a text, and say of its first subword what a single one says
        texts, said = A._split(ids, lens, shares(ids, lens, values, 1))
        for t, h, (p, _) in zip(texts, r.held_out, said):
            assert h or np.allclose(p[1:], tables(np.array([[size - 1, size - 1, *t.tolist(), size - 1]]), 1)[0][0][1:], rtol=1e-5)


def test_orc_tokens(spark, docs, none, odd, tmp_path):
    from tallyforge.llm.token_orc import read_tokens, tokens_round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, at = encoded("byte_bpe_50k.json"), 0
    for r in sorted(tokens_round_trip(docs, path, path=f"file://{tmp_path}/t").collect(), key=lambda r: r.doc_id):
        v = np.array(ids[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(v), zlib.crc32(v))
        at += len(v)
    assert read_tokens(spark, f"file://{tmp_path}/t", [3]).first()["ids"] == ids[3]
    assert tokens_round_trip(none, path).count() == 0 and tokens_round_trip(odd, path).count() == 12


def test_components(spark):
    from tallyforge.llm.components import components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


def test_encoder_is_the_library():
    from tallyforge.llm.encoder import Encoder

    letters = [chr(c) for c in range(0x260)] + list("日ßΣ ' ") + [" "] * 60 + ["'s", "'T", "\n\n", "12", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext"] * 9
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, t = Encoder(public_tokenizers.path(name), 50), Tokenizer.from_file(public_tokenizers.path(name))
        for _ in range(600):
            x = "".join(random.choice(letters) for _ in range(random.randint(0, 25)))
            assert e.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_pipeline(spark, tmp_path):
    """Planted cases on a small table: what must go goes, clean documents stay."""
    import corpus_pipeline

    clean = [(i, sentence(random.randint(30, 120)) + ".") for i in range(150)]
    junk = [(1_000 + i, " ".join(w.upper() + "!!" for w in sentence(60).split())) for i in range(60)]
    copies = [(2_000 + i, clean[i][1]) for i in range(10)]
    dirty = [(3_000, sentence(30) + " " + " ".join(TEST.split()[:16])), (3_001, " ".join(TEST.split()[22:38]))]
    passage = [(4_000 + i, sentence(40) + " " + PASSAGE + " " + sentence(40)) for i in range(4)]
    docs = clean + junk + copies + dirty + passage
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1_000)) for i, _ in clean + junk], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, TEST)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {i for i, _ in clean} | {i for i, _ in passage}
    stage = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, stage.filter("doc_id >= 4000"), "").collect()}
    assert all(PASSAGE not in r.text and r.n_chars == len(r.text) for r in cut.values()) and cut[4_000].text.startswith(passage[0][1][:60])
