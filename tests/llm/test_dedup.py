import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, exchange, jaccard_join, quality_rules, secret_scan, substring_dedup, toxicity
from tidewire.llm.components import components
from tidewire.llm.queries import QUERIES

from ..conftest import SF
from . import brute

SCHEMA = "doc_id long, text string, n long, id string, body string, h string"


def frame(spark, docs, schema=SCHEMA):
    """Rows with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in docs], schema)


# --- exact dedup ----------------------------------------------------------------------------


def groups(rows, keep):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        first = True
        for i in ids:
            kept = i == best and first
            first = first and not kept
            out.append((i, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b " * 9999), (None, "a"), (7, "b " * 9999), (8, "B"), (2, "a"), (None, "only"), (None, "only"), (9, "é")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("clash", [False, True])
def test_exact(spark, keep, clash):
    short = (lambda text: F.substring(F.md5(text), 1, 1)) if clash else exact_dedup.md5_128
    out = exact_dedup.content_groups(frame(spark, ROWS), keep=keep, hash_of=short)
    assert sorted(map(tuple, out.collect()), key=str) == groups(ROWS, keep)


def test_exact_empty(spark):
    assert exact_dedup.content_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.content_groups(frame(spark, []), keep="newest")


def test_drop_copies(spark):
    out = exact_dedup.drop_copies(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "n", "id", "body", "h"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a"), (3, None), (5, "b " * 9999), (8, "B"), (9, "é"), (None, "only")], key=str)


def clashing(spark, rows, names):
    """Rows with extra columns named as something inside, with a value of the row's own."""
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, *(f"{n}-{k}" for n in names)) for k, (i, t) in enumerate(rows)], schema)


INNER = ["__sha", "sha", "SHA_", "id", "__id", "nth", "__n", "row", "__row", "body", "id0", "__id0", "nul", "__nul", "th", "__th", "keep", "component", "lead", "n"]


def keep_clean(docs):
    """With a model that finds nothing toxic."""
    forest = quality_rules.train_forest(np.zeros((20, len(toxicity.FEATURES))), np.zeros(20), list(toxicity.FEATURES.values()))
    return toxicity.keep_clean(docs, toxicity.ToxicityModel(toxicity.Lexicon([]), forest))


@pytest.mark.parametrize("operator", [exact_dedup.drop_copies, jaccard_join.keep_firsts, secret_scan.mask, keep_clean])
@pytest.mark.parametrize("repeats", [False, True])
def test_users_columns_survive(spark, operator, repeats):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "other words here"), (None, "x y")] + ([(4, "other words here")] if repeats else [])
    before = clashing(spark, rows, INNER)
    after = operator(before)
    assert after.schema.simpleString() == before.schema.simpleString()
    given = {tuple(r) for r in before.collect()}
    got = [tuple(r) for r in after.collect()]
    assert set(got) <= given and len(got) == (len(rows) if operator in (secret_scan.mask, keep_clean) else 4)


# --- components -----------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        r, s = sorted((find(a), find(b)))
        parent[s] = r
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_hot_keys_can_be_split(spark):
    """A join to sums of one's own key shuffles both sides, which the engine needs to split a hot key."""
    from tidewire.llm.common import apart

    wanted = {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
        for groups, split in ((lambda g: g, False), (apart, True)):
            joined = rows.join(groups(rows.groupBy("k").agg(F.min("id").alias("least"))), "k")
            assert joined.filter("k = 7 and least = 0").count() == 66_668
            joined.collect()
            assert ("skew=true" in joined._jdf.queryExecution().executedPlan().toString()) == split
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


# --- near copies ----------------------------------------------------------------------------


def near_corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(60)]
    docs, texts = {}, []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            w = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randint(0, 6))]
        elif kind < 0.55:
            w = shared[: rng.randint(40, 60)] + [rng.choice(vocab) for _ in range(rng.randint(0, 8))]
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 10, 15, 30, 60, 90]))]
        texts.append(w)
        docs[i * 3] = " ".join(x.upper() if rng.random() < 0.2 else x for x in w)
    return docs | {1: "", 2: None, 4: "  \n"}


def check_near(spark, docs):
    out = jaccard_join.component_ids(frame(spark, list(docs.items()))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute.jaccard_components(docs)
    assert len(out) == len(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    check_near(spark, near_corpus(seed))


def test_near_with_each_side_of_the_boundary(spark, monkeypatch):
    docs = near_corpus(3, 150)
    for bound in (1, 30, 10**6):
        monkeypatch.setattr(jaccard_join, "boundary", lambda _, b=bound: b)
        check_near(spark, docs)


def test_near_when_centres_do_badly(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GOOD_CENTRES", 2.0)
    check_near(spark, near_corpus(4, 120))


def test_near_with_long_lists(spark, monkeypatch):
    """Many documents that share a rare passage and do not link, in blocks of four rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    docs = {i: " ".join(passage[: rng.randint(36, 40)] + [f"q{rng.randrange(12)}" for _ in range(rng.randint(6, 12))]) for i in range(60)}
    check_near(spark, docs)
    check_near(spark, near_corpus(8, 80))


@pytest.mark.parametrize("bound", [1, 30, 10**6])
def test_near_with_every_list_parted(spark, monkeypatch, bound):
    monkeypatch.setattr(jaccard_join, "boundary", lambda _, b=bound: b)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    seen = []
    parted = jaccard_join.narrowed

    def narrowed(lists, prefixes):
        monkeypatch.setattr(jaccard_join, "SCAN_COST", 1e9)
        out = parted(lists, prefixes)
        seen.append(lists.count())
        return out

    monkeypatch.setattr(jaccard_join, "narrowed", narrowed)
    check_near(spark, near_corpus(11 + bound % 7, 120))
    assert seen and seen[0]


def test_a_long_list_forms_few_pairs(spark, monkeypatch):
    """3000 sets that share one shingle and no two of which link: pairs that share no other one are not formed."""
    monkeypatch.setattr(jaccard_join, "SCAN_COST", 0.05)
    rng = np.random.default_rng(5)
    common, n, sets = 7, 100, 3000
    tokens = {i: np.concatenate([[common], np.sort(rng.choice(np.arange(100, 60_000), 22, replace=False))]).astype(np.uint64) for i in range(sets)}
    prefixes = spark.createDataFrame([(i, n, 0, t.tobytes(), b"") for i, t in tokens.items()], jaccard_join.PREFIXES)
    lists = spark.createDataFrame([(common, i, n, 0, False, 0.0, i) for i in tokens], jaccard_join.POSTINGS + ", root long")
    parted = jaccard_join.narrowed(lists, prefixes)
    pairs = jaccard_join.cross_pairs(parted, spark.createDataFrame([], "a long, b long"))
    got = {(r.a, r.b) for r in pairs.collect()}
    seen = defaultdict(list)
    for i, t in tokens.items():
        for x in t[1 : jaccard_join.prefix(n, 2)].tolist():
            seen[x].append(i)
    assert got == {(a, b) for own in seen.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    assert len(got) < sets * sets / 2 / 100


def test_near_corner_cases(spark):
    assert jaccard_join.component_ids(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "A b c d e f"), (None, None), (6, "x"), (7, "x"), (8, "x y"), (9, "wörd " * 50), (10, "wörd " * 60)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.component_ids(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (10, 1, 9)], key=str)
    kept = jaccard_join.keep_firsts(frame(spark, [*rows, (6, "x"), (11, None), (11, None)]))
    assert kept.columns == ["doc_id", "text", "n", "id", "body", "h"]
    assert sorted(((r.doc_id, (r.text or "")[:3]) for r in kept.collect()), key=str)[:6]
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(6) == 1 and ids.count(11) == 1 and 7 not in ids and 10 not in ids


@pytest.fixture()
def small_groups(monkeypatch):
    """Groups of three buckets and chunks of some documents, so that small inputs take both steps in many chunks."""
    monkeypatch.setattr(exchange, "GROUP", 3)
    monkeypatch.setattr(exchange, "CHUNK_HASHES", 300)
    monkeypatch.setattr(exchange, "SHARE", 1)
    monkeypatch.setattr(exchange, "SLICES", 2)


def test_near_in_two_steps(spark, small_groups):
    check_near(spark, near_corpus(5, 150))


def test_repeats_in_two_steps(spark, small_groups):
    check_repeats(spark, passages(4))


def test_both_kinds_of_exchange_are_tested(spark, small_groups, monkeypatch):
    seen = []
    plain = exchange.stored
    monkeypatch.setattr(exchange, "stored", lambda df, label, *a: seen.append(label) or plain(df, label, *a))
    check_near(spark, near_corpus(6, 40))
    check_repeats(spark, passages(5, 20))
    assert seen == ["dealt"] * 4


@pytest.mark.parametrize("tb", [0.0001, 0.01, 1, 10, 100])
def test_a_chunk_is_bounded_at_every_size(tb):
    buckets = int(tb * 1e12 / 6.5 / exchange.BUCKET_HASHES) + 1
    groups = -(-buckets // exchange.GROUP)
    assert exchange.chunk_size(buckets) <= exchange.MOST_HASHES == 1 << 21
    # Shares stay worth a row: of a group in the first step, of a bucket in the second.
    assert exchange.chunk_size(buckets) / (buckets if groups == 1 else groups) >= 500
    assert exchange.chunk_size(buckets) / min(buckets, exchange.GROUP) >= 500


def test_prefix_bound():
    for n in range(1, 200):
        assert 100 * jaccard_join.least_overlap(n) >= 80 * n > 100 * (jaccard_join.least_overlap(n) - 1)


# --- repeated passages ----------------------------------------------------------------------


def passages(seed, n=80):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    common = [[rng.choice(vocab) for _ in range(rng.choice([19, 20, 21, 33, 70]))] for _ in range(6)]
    docs = {}
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(common) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 50))]
        docs[(i * 37) % 1009] = " ".join(w)
    docs[2000] = "same " * 90
    return docs | {3000: None, 3001: ""}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    check_repeats(spark, passages(seed))


def check_repeats(spark, docs):
    want = {i: (len(brute.words(docs[i])), " ".join(k)) for i, k in brute.removed_words(docs).items()}
    out = substring_dedup.remove_repeats(frame(spark, list(docs.items())).repartition(3), with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.kept_text) for r in out} == want
    for r in out:
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][1].encode()).hexdigest()
        assert r.n_removed == r.n_words - len(r.kept_text.split(" ") if r.kept_text else [])


def test_repeats_corner_cases(spark):
    text = " ".join(f"k{i}" for i in range(30))
    rows = [(None, text), (3, text), (3, text), (4, text + " tail"), (5, "short")]
    out = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert out == sorted([(None, 30), (3, 0), (3, 0), (4, 30), (5, 0)], key=str)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(frame(spark, rows), window=20, block=11)
    with pytest.raises(TypeError):
        substring_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_very_long_texts(spark):
    """Texts of 60 000 words: a near copy, a copy of a long part, and others."""
    words = [f"long{i}" for i in range(60_000)]
    near = [w if i % 900 else f"x{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:30_000])), (4, "long1 long2"), (5, " ".join(["same"] * 50_000))]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.component_ids(frame(spark, rows)).collect()}
    assert out == {1: (59_996, 1), 2: (59_996, 1), 3: (29_996, 3), 4: (1, 4), 5: (1, 5)}
    gone = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    # Between two changed words of the near copy stand 899 words that are all in the first text.
    assert gone == {1: 0, 2: 60_000 - 67, 3: 30_000, 4: 0, 5: 49_999}
    kept = {r.doc_id: r.kept for r in exact_dedup.content_groups(frame(spark, [*rows, (6, rows[0][1])]), keep="largest").collect()}
    assert kept == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_registered(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    near = QUERIES["op8_jaccard_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near} == brute.jaccard_components(docs)
    kept = brute.removed_words(docs)
    for r in QUERIES["op10_substring_dedup"](spark, SF).collect():
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept[r.doc_id]).encode()).hexdigest()
