import gzip
import hashlib
import io
import random
import zlib
from base64 import b32encode

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidewire.llm import packing, secret_scan, toxicity, warc
from tidewire.llm.common import stored
from tidewire.llm.oracles import ORACLES
from tidewire.llm.queries import QUERIES

from ..conftest import SF
from . import brute

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- packing --------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", " ", "  ", "\n", "é", "字", "🙂", "'s", "<|endoftext|>", "123", "\xa0", " ", "...", "\x00"]), max_size=20).map("".join)))
def test_ids_equal_the_library(text):
    t = packing.tokenizer(JSON, RANKS)
    assert t.fast is not None and t.encode(text).tolist() == t.plain(text)


def test_rank_encoder_is_used_only_if_it_is_the_same():
    import base64
    import json

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    file = json.load(open(JSON))
    library = packing.Tokenizer.from_file(JSON)
    assert packing.same_encoding(library, file, ranks)
    swapped = dict(ranks)
    x, y = list(swapped)[300:302]
    swapped[x], swapped[y] = swapped[y], swapped[x]
    assert not packing.same_encoding(library, file, swapped)
    merges = file["model"]["merges"]
    other = file | {"model": file["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}}
    assert not packing.same_encoding(library, other, ranks)
    assert not packing.same_encoding(library, file | {"normalizer": {"type": "NFC"}}, ranks)


def test_every_character_splits_alike():
    """The pattern's classes of all code points: each beside letters, digits, marks and white space of its own."""
    t = packing.tokenizer(JSON, RANKS)
    for first in range(0, 0x110000, 512):
        text = "".join(f"a{c}b 1{c}2 {c} {c}{c} .{c}! \n{c}'s" for c in map(chr, range(first, first + 512)) if not 0xD800 <= ord(c) < 0xE000)
        assert t.encode(text).tolist() == t.plain(text), hex(first)


def test_white_space_beyond_the_rank_encoder():
    t = packing.tokenizer(JSON, RANKS)
    for text in (" " * 200_000, " " * 200_000 + "a", "\n" * 100_000, "ab" * 100_000):
        assert t.encode(text).tolist() == t.plain(text)


def test_cut():
    for n in (1, 2047, 2048, 2049, 4096, 4097, 10000):
        pieces = packing.cut(n, 2048)
        assert pieces[0][0] == 0 and sum(s for _, s in pieces) == n
        assert all(s == 2048 for _, s in pieces[1:]) and all(a + s == b for (a, s), (b, _) in zip(pieces, pieces[1:], strict=False))


def test_mixed_numbers_are_distinct():
    assert len({packing.mixed(i) for i in range(20000)}) == 20000


def triplets(n, g):
    """Three pieces to a bin without a token of room: n bins are enough."""
    out = []
    for _ in range(n):
        one = g.randint(380, 490)
        two = g.randint((2048 - one) // 2 - 200, (2048 - one) // 2)
        out += [one, two, 2048 - one - two]
    return out


def uniform(low, high, n, g):
    return [g.randint(low, high) for _ in range(n)]


FAMILIES = {
    "300-900": lambda g: uniform(300, 900, 300, g),
    "400-1000": lambda g: uniform(400, 1000, 600, g),
    "200-1400": lambda g: uniform(200, 1400, 500, g),
    "60 triplets": lambda g: triplets(60, g),
    "200 triplets": lambda g: triplets(200, g),
}


def check_bins(p, bins):
    n = len(p.sizes)
    assert sorted(i for b in bins for i in b) == list(range(n))
    fills = [sum(p.sizes[i] for i in b) for b in bins]
    assert fills == [b.fill for b in bins] and max(fills, default=0) <= p.capacity and p.bound <= len(bins)
    again = packing.as_bins(packing.as_bytes(bins, n))
    assert sorted(map(sorted, again)) == sorted(map(sorted, bins))


@pytest.mark.parametrize("family", FAMILIES)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fewer_bins_than_best_fit(family, seed):
    p = packing.Packer(FAMILIES[family](random.Random(seed)), 2048, seed)
    plain = p.best_fit(p.falling(list(range(len(p.sizes)))), [])
    bins = p.evolve([], 10, 8)
    check_bins(p, bins)
    assert len(bins) < len(plain)


def optimum(sizes, capacity):
    """Fewest bins, over all orders of filling: (bins, least fill of the last) of every subset."""
    best = {0: (0, capacity)}
    for subset in range(1, 1 << len(sizes)):
        options = []
        for i, size in enumerate(sizes):
            if subset >> i & 1:
                bins, fill = best[subset ^ (1 << i)]
                options.append((bins, fill + size) if fill + size <= capacity else (bins + 1, size))
        best[subset] = min(options)
    return best[(1 << len(sizes)) - 1][0]


def test_optimum_of_few_pieces():
    g = random.Random(9)
    better = 0
    for k in range(40):
        sizes = [uniform(20, 60, 11, g), uniform(10, 50, 12, g), uniform(15, 70, 10, g)][k % 3]
        p = packing.Packer(sizes, 100, k)
        bins = p.evolve([], 30, 8)
        check_bins(p, bins)
        assert len(bins) == optimum(sizes, 100)
        better += len(bins) < len(p.best_fit(p.falling(list(range(len(sizes)))), []))
    assert better


@pytest.mark.parametrize("sizes", [[], [1], [2048] * 5, [1] * 5000])
def test_packer_corner_cases(sizes):
    p = packing.Packer(sizes, 2048, 1)
    bins = p.evolve([], 5, 4)
    check_bins(p, bins)
    assert len(bins) == p.bound


def check_packing(rows, docs, capacity):
    t = packing.tokenizer(JSON, RANKS)
    want = []
    for i, text in docs:
        ids = np.array([*t.plain(text or ""), 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_small(spark):
    g = random.Random(2)
    docs = [(i, " ".join(g.choice(["lorem", "ipsum", "dolor"]) for _ in range(g.randint(0, 90)))) for i in range(300)]
    docs += [(None, "x y"), (5, "again"), (5, "again"), (900, None), (901, ""), (902, "long " * 700)]
    frame = spark.createDataFrame([(*d, 1, "r") for d in docs], "doc_id long, text string, row long, shard string")
    rows = packing.pack(frame, JSON, RANKS, capacity=128, shard_items=100).collect()
    n = check_packing(rows, docs, 128)
    assert n <= 1.03 * sum(r.length for r in rows) / 128 + 2
    assert packing.pack(frame.limit(0), JSON, RANKS).count() == 0


def test_pack_without_rank_file(spark):
    frame = spark.createDataFrame([(1, "Hello <|endoftext|> 字")], "doc_id long, text string")
    a, b = (packing.pack(frame, JSON, r).select("ids_crc32", "length").collect() for r in (None, RANKS))
    assert a == b


# --- archives -------------------------------------------------------------------------------

PAGES = [
    (5, "http://a/1", "same"), (2, "http://b/\r\nx", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""), (4, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb"),
    (None, "u", "same"), (7, "u", "é字🙂" * 3000), (8, "u", "tiny"), (10, "u", "tiny"),
]


def archived(spark, pages, least=0):
    frame = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, nth int")
    return sorted((tuple(r) for r in warc.archive_pages(frame, min_payload_bytes=least).collect()), key=str)


def resolved(pages, least=0):
    first, out = {}, []
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (h or "").encode()
        digest = b32encode(hashlib.sha1(raw).digest()).decode()
        known = raw in first and len(raw) >= least
        out.append((i, len(raw), digest, "revisit" if known else "response", first[raw] if known else None))
        first.setdefault(raw, i)
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    assert archived(spark, PAGES, least) == resolved(PAGES, least)


def test_archives_empty(spark):
    assert archived(spark, []) == []


def written(folder):
    """The archives of a folder; the engine's first task leaves an empty file if it has no archive."""
    return [f for f in folder.glob("part-*") if f.stat().st_size]


@pytest.mark.parametrize("codec", ["none", "gzip"])
def test_archive_files(spark, tmp_path, codec):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive_pages(frame, path=str(tmp_path / "w"), codec=codec).count()
    seen = []
    for f in written(tmp_path / "w"):
        with warc.opened(str(f)) as stream:
            assert stream.read(10) == b"WARC/1.1\r\n"
        for headers, block in warc.records(warc.opened(f"file:{f}")):
            assert int(headers["content-length"]) == len(block)
            head, _, payload = block.partition(b"\r\n\r\n")
            if headers["warc-type"] == "response":
                assert warc.digest_of(headers, block) == b32encode(hashlib.sha1(payload).digest()).decode()
                seen.append(headers["warc-record-id"])
            else:
                assert not payload and headers["warc-profile"] == warc.PROFILE and headers["warc-refers-to"].startswith("<urn:uuid:")
    assert len(set(seen)) == 5


def test_every_record_is_a_member(spark, tmp_path):
    """Each record can be reached by its own place in the archive, and plain gzip reads the whole."""
    import zlib as z

    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.archive_pages(frame, path=str(tmp_path / "w")).count()
    members = 0
    for f in written(tmp_path / "w"):
        data = f.read_bytes()
        assert gzip.decompress(data).count(b"WARC-Record-ID") > 0
        while data:
            d = z.decompressobj(31)
            record = d.decompress(data)
            assert d.eof and (not record or (record.startswith(b"WARC/1.1") and record.endswith(b"\r\n\r\n")))
            members += bool(record)
            data = d.unused_data
    assert members == len(PAGES)


def test_archives_are_bounded(spark, tmp_path):
    """Archives far over file_bytes are parted; a record that is longer has one of its own."""
    g = random.Random(4)
    pages = [(i, "u", g.randbytes(3000).hex()) for i in range(200)] + [(500, "u", g.randbytes(200_000).hex()), (501, None, "tail")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    out = warc.archive_pages(frame, path=str(tmp_path / "w"), file_bytes=50_000).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in out) == sorted((i, len(h)) for i, _, h in pages)
    sizes = sorted(f.stat().st_size for f in written(tmp_path / "w"))
    assert len(sizes) > 10 and sizes[-2] < 60_000 < sizes[-1]


def test_members_that_do_not_end_in_zero():
    a = warc.Archive("gzip")
    a.add(b"x" * (17 << 20))
    assert len(gzip.decompress(a.cut() + b"\0")) == (17 << 20) + 4


def test_gzip_members_and_broken_files():
    stream = lambda b: gzip.GzipFile(fileobj=io.BytesIO(b)) if b[:2] == b"\x1f\x8b" else io.BytesIO(b)
    record = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.records(stream(gzip.compress(record) + gzip.compress(record)))] == [b"ab", b"ab"]
    for broken in (record[:-5], b"HTTP/1.1\r\n", record + b"x"):
        with pytest.raises(ValueError):
            list(warc.records(stream(broken)))
    headers = {"warc-type": "response", "warc-record-id": "1", "warc-payload-digest": "sha1:" + b32encode(hashlib.sha1(b"ab").digest()).decode()}
    assert warc.digest_of(headers, b"HTTP\r\n\r\nab") and pytest.raises(ValueError, warc.digest_of, headers, b"HTTP\r\n\r\nax")


# --- queries with SQL -----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert key(df.collect(), df.columns) == key(result.fetchall(), columns)


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        kept.append(docs.collect())
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(source)
    clean = [i for i, p in zip(ids, model.score([source[i] for i in ids]), strict=True) if p < 0.5]
    assert sorted(r.doc_id for r in kept[0]) == clean
    firsts = {}
    for i in clean:
        firsts.setdefault(source[i], i)
    assert sorted(r.doc_id for r in kept[1]) == sorted(firsts.values())
    near = brute.jaccard_components({i: source[i] for i in firsts.values()})
    assert sorted(r.doc_id for r in kept[2]) == sorted({c for _, c in near.values()})
    assert {r.doc_id: r.text for r in kept[3]} == {r.doc_id: secret_scan.redact(r.text) for r in kept[2]}
    check_packing(kept[4], [(r.doc_id, r.text) for r in kept[3]], 2048)


def test_workers_forget_what_another_purpose_kept():
    from tidewire.llm import common

    common.word_hashes([b"a", b"b"])
    assert len(common.WORD_HASHES) == 2
    model = toxicity.ToxicityModel(toxicity.Lexicon([]), None)
    assert model.scorer() is model.scorer() and not common.WORD_HASHES
    common.word_hashes([b"a"])
    assert not toxicity._SCORERS and len(common.WORD_HASHES) == 1
    before = packing.tokenizer(JSON, RANKS)
    common.serving("tokens")
    assert packing.tokenizer(JSON, RANKS) is before and not common.WORD_HASHES


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"none-{name}")
        assert docs.count() == 0


def test_pipeline_with_nulls_ties_and_other_columns(spark, tmp_path):
    """Null ids and texts, repeated rows and columns with the names that stages use, through all stages."""
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    texts = [None, None, "", "one two three four five six seven", "one two three four five six seven", "one two three four five six seven eight", long, "password = hunter22 here", "x"]
    rows = [(None if i % 4 == 1 else i // 2, t, 1.5, None, "k", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, sha string, row string, n_chars long")
    spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    kept = {(r.text or "") for r in docs.collect()}
    # 9 rows, of which five texts repeat or are near; the empty text counts once.
    assert sizes[0] == 9 and sizes[1] == 6 and kept >= {"", long, "x", "[secret] here"} and len(kept) == sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.filter("piece = 0").count() == docs.count()


def test_a_step_takes_its_checkpoints_along(spark):
    from tidewire.llm import common

    before = None

    def step():
        nonlocal before
        common.scratch_dir(spark)
        out = common.checkpointed(spark.range(10))
        before = common.checkpoints(spark)
        return out

    assert common.finished(spark, step, "step").count() == 10
    assert len(before - common.checkpoints(spark)) == 1
