"""Token alignment against a plain walk over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewire.llm import alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
rng = random.Random(4)
TEXTS = [
    None, "", "a", " ", "Hello  world\n", "字🙂 é", "<|endoftext|> <s> </s>", "x▁y", "x" * 300, "don't stop — 123456 tionaux", "\t\n  \n",
    "same text", "same text", " ".join(rng.choice(["the", "naïve", "über", "字"]) for _ in range(3000)),
    *[" ".join(rng.choice(["the", "naïve", "über", "字", "antidisestablish", "x1y2"]) for _ in range(40)) for _ in range(12)],
]


def tokenizers():
    return alignment.tokenizers_of(FILES[0], FILES[2], FILES[1])


def token_bytes():
    """Ids and bytes of both sides straight from the libraries."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def both(text):
        e = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        raw = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])

    return both


def ends(tokens):
    out, at = [], 0
    for _, raw in tokens:
        out.append(at := at + len(raw))
    return out


def plain(texts):
    both, rows, count = token_bytes(), [], Counter()
    for text in texts:
        left, right = both(text) if text else ([], [])
        ea, eb = ends(left), ends(right)
        cuts, before, groups = sorted(set(ea) & set(eb)), 0, []
        for cut in cuts:
            side = lambda tokens, e: ",".join(str(i) for (i, _), end in zip(tokens, e, strict=True) if before < end <= cut)  # noqa: B023, E731
            groups.append(f"{side(left, ea)}|{side(right, eb)}")
            before = cut
        links, j = [], 0
        for (i, raw), end in zip(left, ea, strict=True):
            while j and eb[j - 1] > end - len(raw):
                j -= 1
            while j < len(eb) and (eb[j - 1] if j else 0) < end:
                if eb[j] > end - len(raw):
                    links.append((i, right[j][0]))
                j += 1
        count.update(links)
        rows.append((len(left), len(right), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(na, nb, ng, len(l), sum(count[p] == top[p[1]] for p in l), sum(count[p] for p in l), h) for na, nb, ng, l, h in rows]


@pytest.mark.parametrize("stretch,block", [(None, None), (500, None), (None, 50), (1, 1)])
def test_query_equals_the_plain_walk(spark, monkeypatch, stretch, block):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stretch int, id string")
    if stretch or block:  # workers take their own constants: the functions are held against each other in this process
        monkeypatch.setattr(alignment, "STRETCH", stretch or alignment.STRETCH)
        s, n_a, n_b = alignment.aligned(tokenizers(), TEXTS)

        want = plain(TEXTS)
        assert s.group_text() == [w[6] for w in want]
        pairs, counts, doc, number, times = s.links()
        assert np.bincount(doc, times, len(TEXTS)).astype(int).tolist() == [w[3] for w in want]
        assert counts.sum() == sum(w[3] for w in want) and len(set(pairs.tolist())) == len(pairs)
        assert [n_a.tolist(), n_b.tolist(), s.per_document(s.shared).tolist()] == [[w[k] for w in want] for k in range(3)]
        return
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, *FILES).collect()}
    want = plain([*TEXTS, "a b"])
    assert [got[i] for i in range(len(TEXTS))] == want[:-1] and got[None] == want[-1]


def test_stretches_of_a_batch(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["ab", None, "x" * 9, "", "cd", "ef"])], names=["id", "body"])
    monkeypatch.setattr(alignment, "STRETCH", 5)
    assert [p.column(0).to_pylist() for p in alignment.stretches(batch)] == [[0, 1], [2], [3, 4, 5]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab ▁\n'1é", max_size=40), max_size=5))
def test_bitsets_give_the_tokens_of_each_group(texts):
    s, n_a, n_b = alignment.aligned(tokenizers(), texts)
    want = plain(texts)
    assert [w[0] for w in want] == n_a.tolist() and [w[6] for w in want] == s.group_text()


def test_white_space_that_the_rank_encoder_refuses():
    s, n_a, _ = alignment.aligned(tokenizers(), ["\t" * 3_000_000 + "<|endoftext|>", "a"])
    library = tokenizers().library
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in (" " + "\t" * 3_000_000 + "<|endoftext|>", " a")]
    assert n_a.tolist() == want and len(s.per_document(s.shared)) == 2


def test_bits():
    places = np.array([1, 63, 64, 65, 127, 128, 200])
    b = alignment.Bits.of(places, 200)
    assert b.select().tolist() == places.tolist() and b.select(64, 127).tolist() == [64, 65, 127] and len(b) == 7
    assert b.rank(np.arange(202)).tolist() == [int((places < p).sum()) for p in range(202)]


def test_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r, w in zip(alignment.token_groups(df, *FILES).orderBy("doc_id").collect(), plain(TEXTS), strict=True):
        groups, a, b = [], 0, 0
        for x, y in zip(r.a_cuts, r.b_cuts, strict=True):
            groups.append(",".join(map(str, r.a_ids[a:x])) + "|" + ",".join(map(str, r.b_ids[b:y])))
            a, b = x, y
        assert (len(r.a_ids), len(r.b_ids), len(groups)) == w[:3]
        assert (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") == w[6]
    assert alignment.align(df.limit(0), *FILES).count() == 0
    assert alignment.token_groups(df.limit(0), *FILES).count() == 0
