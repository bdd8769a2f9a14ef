"""Nulls, repeated rows, empty tables and clashing columns in each operator and pipeline stage; the discriminant against a plain one; what
the ORC files hold."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

random.seed(11)
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = "the quick brown fox jumps over the lazy dog and runs home again before dark falls on the hills"
ROWS = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, "no id here"), (None, None), (4, "Ünïcode ✓ text\n\n two")]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, rows without an id, null and empty texts; other columns have names that the operators use within."""
    return spark.createDataFrame([(i, t, "k", 1.0, i) for i, t in ROWS], "doc_id long, text string, key string, score double, id long").repartition(2)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_media_of_odd_rows(odd, none):
    from tallyforge.llm.media_jpeg import text_media

    got = sorted(((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in text_media(odd).collect()), key=str)
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert [g[:4] for g in got] == sorted(want, key=str)
    for t in {t or "" for _, t in ROWS}:  # equal texts, equal values
        assert len({g[4:] for g in got if g[1] == len(t.encode()) and g[2] == hashlib.sha256(t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))).hexdigest()}) == 1
    assert text_media(none).count() == 0


def test_stored_pictures_are_what_they_say(odd):
    from tallyforge.llm.media_jpeg import encode_text, text_media

    stored = {(r.doc_id, hashlib.sha256(bytes(r.media)).hexdigest(), len(r.media)) for r in encode_text(odd).collect()}
    assert stored == {(r.doc_id, r.media_sha256, r.media_bytes) for r in text_media(odd).collect()}
    assert all(bytes(r.media[:2]) == b"\xff\xd8" and b"\xff\xc2" in bytes(r.media) for r in encode_text(odd).collect())  # progressive


def test_token_files_of_odd_rows(odd, none):
    from tokenizers import Tokenizer

    from tallyforge.llm.token_counts import documents_round_trip

    t = Tokenizer.from_file(WORDS)
    got = sorted(((r.doc_id, r.n_tokens) for r in documents_round_trip(odd, WORDS).collect()), key=str)
    assert got == sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in ROWS), key=str)
    assert documents_round_trip(none, WORDS).count() == 0


def test_quality_is_a_plain_discriminant(spark):
    from tallyforge.llm.quality import FEATURES, quality_scores, statistics

    texts = [" ".join(random.choice(TEXT.split()) for _ in range(random.randint(5, 90))) + "." for _ in range(120)] + [" ".join(random.choice(["BUY!!", "$$$", "now", "NOW NOW", "x"]) for _ in range(random.randint(5, 90))) for _ in range(80)] + [None, ""]
    labels = {i: int(i < 120) for i in range(200) if i % 3}
    got = {r.doc_id: r for r in quality_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    raw = [(t or "").encode() for t in texts]
    x = statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))])
    known = [[i for i, y in labels.items() if y == k and fold[i]] for k in (0, 1)]
    own = [np.cov(x[k].T) for k in known]
    n = [len(k) for k in known]
    pooled = sum(c * (m - 1) for c, m in zip(own, n)) / (sum(n) - 2)
    logs = []
    for k in (0, 1):
        c = 0.9 * own[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * np.diag(np.diag(c)) + 1e-6 * np.eye(len(FEATURES))
        d = x - x[known[k]].mean(0)
        logs.append(np.log((n[k] + 0.5) / (sum(n) + 1)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose([got[i].score for i in range(len(texts))], want, rtol=1e-5, atol=1e-9)
    assert all(got[i].held_out == (fold[i] == 0) and got[i].predicted == int(want[i] >= 0.3) for i in got)


def test_quality_of_odd_rows(spark, odd, none):
    from tallyforge.llm.quality import quality_scores

    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_scores(odd, labels).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality_scores(none, labels).count() == 0 and quality_scores(odd, labels.limit(0)).count() == len(ROWS)


def test_orc_files_have_filters_and_stripes(spark, tmp_path, monkeypatch):
    from pyarrow import orc

    from tallyforge.llm import token_orc

    monkeypatch.setitem(token_orc.ORC_OPTIONS, "orc.stripe.size", "65536")
    monkeypatch.setitem(token_orc.ORC_OPTIONS, "orc.stripe.row.count", "1000")
    docs = spark.createDataFrame([(i * 3, " ".join(random.choice(TEXT.split()) for _ in range(60))) for i in range(8_000)], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    files = sorted((tmp_path / "t").glob("*.orc"))
    opened = [orc.ORCFile(str(f)) for f in files]
    assert max(f.nstripes for f in opened) > 1 and {f.row_index_stride for f in opened} == {1000}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{files[0]}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    columns = spark.sparkContext._gateway.new_array(jvm.boolean, 4)
    for k in range(4):
        columns[k] = True
    filters = reader.rows().readRowIndex(0, columns, columns).getBloomFilterIndex()
    assert filters[1] is not None and filters[3] is None  # on doc_id alone
    assert {r["doc_id"] for r in token_orc.read_tokens(spark, path, [300, 301, 6_000]).collect()} == {300, 6_000}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert token_orc.read_tokens(spark, path).rdd.getNumPartitions() > len(files)  # stripes of a file go to several tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stages_of_odd_rows(spark, tmp_path):
    """Each pipeline stage on nulls, repeated rows, an empty table and columns with names it uses within."""
    import corpus_pipeline

    long = " ".join(f"w{k}" for k in range(70))
    bench = " ".join(f"b{k}" for k in range(20))
    rows = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, "no id here"), (4, long + " tail one"), (5, long + " other end"), (6, bench + " x"), (7, TEXT.replace("dark", "night"))]
    home = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(9, bench), (None, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, id int")
    stage = dict(corpus_pipeline.STAGES)
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, docs.limit(0), home)
        assert empty.count() == 0, name
        if name != "packing":
            assert empty.columns == docs.columns and f(spark, docs, home).columns == docs.columns, name
    kept = sorted(str(r.doc_id) for r in stage["near_duplicates"](spark, docs, home).collect())
    assert kept == sorted(map(str, [1, 1, 2, 3, None, 4, 6, 7]))  # 5 is nearly 4
    cut = {(r.doc_id, r.text, r.n_chars) for r in stage["repeated_passages"](spark, docs, home).collect()}
    assert (4, "tail one", 8) in cut and (5, "other end", 9) in cut and (2, None, None) in cut and (3, "", 0) in cut
    assert (7, TEXT.replace("dark", "night"), len(TEXT) + 1) in cut
    clean = [r.doc_id for r in stage["decontamination"](spark, docs, home).collect()]
    assert 6 not in clean and len(clean) == len(rows) - 1 and clean.count(1) == 2 and clean.count(None) == 1
    packed = stage["packing"](spark, docs, home).collect()
    assert len(packed) == len(rows) and sum(r.length for r in packed if r.doc_id is None) > 1


def test_written_tables_go_after_their_last_reader(spark):
    """What is left in the shared folder is what the returned plans read, and tables of a few rows; the input isn't touched."""
    from tallyforge.llm.common import shared_folder, stash
    from tallyforge.llm.minmax_dedup import near_duplicates
    from tallyforge.llm.suffix_dedup import suffix_dedup

    text = " ".join(f"word{i}" for i in range(120))
    docs = stash(spark.createDataFrame([(i, text + f" end{i % 3} of this") for i in range(9)] + [(9, "no copy"), (10, None)], "doc_id long, text string"), "input")
    folder = Path(shared_folder(spark).removeprefix("file://"))

    def left(query) -> set[str]:
        had = set(folder.iterdir())
        query()
        return {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - had}

    def strings():
        assert suffix_dedup(docs).orderBy("doc_id").first()["n_removed"] > 0

    def sets():
        assert [r["component_id"] for r in near_duplicates(docs, 3, 85).orderBy("doc_id").collect()] == [0] * 9 + [9, 10]

    assert left(strings) == {"large-groups", "losses", "results"}
    assert left(sets) == {"signatures", "sets", "labels", "links"}
    assert docs.count() == 11
