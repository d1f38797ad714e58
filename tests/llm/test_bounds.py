"""What comes to the driver or stays in a worker is bounded, whatever the tables hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import language_id, quality_rules, toxicity
from tidewire.llm.common import Memo
from tidewire.llm.piece_codec import PieceCodec

from .test_text_operators import MODEL


def test_a_sample_has_one_row_an_id(spark):
    """Repeated ids, copies, ids with both labels, nulls: at most `most` rows, of each id the text with the smallest hash."""
    rows = [(i % 7, f"text {i % 35}") for i in range(3000)] + [(8, None), (None, "x"), (9, "same"), (9, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 50 + [(3, 0), (8, 1), (None, 1), (9, 0), (5, None)], "doc_id long, quality int")
    got = quality_rules.labelled_sample(docs, labels, "quality", 4000).collect()
    assert len(got) == 9  # a null text is an empty one
    hashes = {r.text: r.h for r in docs.filter("text is not null").select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    own = {i: min((t for j, t in rows if j == i), key=hashes.get) for i in (*range(7), 9)}
    want = [(own[i], int(i % 2) if i < 7 else 0) for i in own] + [("", 1)]
    assert sorted((r.body or "", r.y) for r in got) == sorted(want)
    assert quality_rules.labelled_sample(docs, labels, "quality", 3).count() == 3
    ones = quality_rules.labelled_sample(docs, labels, "quality", 4000, only=1)
    assert sorted(r.body or "" for r in ones.collect()) == sorted(["", *(own[i] for i in (1, 3, 5))])


def test_the_lexicon_is_that_of_all_terms(spark, monkeypatch):
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcdeg") for _ in range(4)) for _ in range(60)]
    counts = {}
    for _ in range(3000):
        w = rng.choice(stems) + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))
        stem = rng.random() < 0.4
        a, b = rng.randint(0, 60), rng.randint(0, 30)
        counts[w, stem] = (a, b, a + rng.randint(0, 9), b + rng.randint(0, 9))
    rows = [(t, s, *c) for (t, s), c in counts.items()]
    frame = spark.createDataFrame(rows + [("", False, 100, 200, 9000, 9000)], "term string, stem boolean, a long, b long, ta long, tb long")
    for most, page in ((5, 3), (12, 2000), (300, 10)):
        monkeypatch.setattr(toxicity, "PAGE", page)
        few = toxicity.rows_of_lexicon(frame, 100, 200, most)
        want = toxicity.learn_lexicon(rows, 100, 200, 9000, 9000, most=most).entries
        assert toxicity.learn_lexicon(few, 100, 200, 9000, 9000, most=most).entries == want and want
    assert toxicity.rows_of_lexicon(frame, 0, 200, 9) == []


def test_memo_is_bounded_in_bytes():
    m = Memo(lambda k: k * 2, 1000, 20_000)
    for i in range(5000):
        assert m[f"key{i}"] == f"key{i}" * 2
    assert len(m) + len(m.old) < 400
    long = "я" * 5000
    assert m[long] == long * 2 and long not in m and long not in m.old


def test_texts_without_spaces_are_not_kept():
    codec, rng = PieceCodec(MODEL), random.Random(2)
    for _ in range(20):
        codec.encode("".join(rng.choice("абвгдежзик") for _ in range(5000)))
    assert sum(len(k) for k in codec.word) + sum(len(k) for k in codec.segment) == 0


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(500)]
    rows = [(i if i % 3 else None, n, f"{n} {n[::-1]} wort {'abc'[i % 3] * 5}") for i, n in enumerate(names * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert model.languages == names and model.log_p.shape == (500, language_id.SLOTS)
    want = np.full(language_id.SLOTS, language_id.ALPHA)
    for _, n, text in rows:
        if n == "l123":
            want += np.bincount(language_id.trigrams(text), minlength=language_id.SLOTS)
    assert np.allclose(model.log_p[123], np.log(want / want.sum()))
    with pytest.raises(ValueError):
        language_id.train(docs, most_languages=499)
    assert language_id.train(docs.limit(0)).languages == []
