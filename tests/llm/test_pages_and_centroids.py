"""Main texts of pages whose article is known; Lloyd rounds against exact whole numbers."""

import hashlib
import html
import math
import random
import re
import time

import duckdb
import pytest

from tidewire.llm import centroids
from tidewire.llm.html_extraction import extract_main, main_text, main_texts, runs
from tidewire.llm.oracles import ORACLES

from ..conftest import SF

# --- pages ----------------------------------------------------------------------------------


def test_pages_of_the_table(spark):
    """The table's pages have one article of headings and paragraphs: all of it, nothing else."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    given = {r.page_id: r for r in pages.collect()}
    rows = main_texts(pages).collect()
    assert len(rows) == len(given)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", given[r.page_id].html, re.S)[1].replace("<br>", " ")
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(filter(None, lines)) and r.n_chars == len(r.text) and r.url == given[r.page_id].url


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
CHROME = [
    "<nav><ul><li><a href='/'>Home</a><li><a>News</a></ul></nav>", "<div class='ad'>Buy this now, the best of all.</div>", "<aside><p>Also of interest to you.</p></aside>",
    "<div id=cookie-notice role=alert><p>We use cookies. Accept?</p></div>", "<form><p>Your name</p><input><button>Send</button></form>", "<script>if (a < b) { x = '<p>no</p>' }</script>",
    "<style>p > a { }</style>", "<!-- <p>hidden</p> -->", "<div class=sidebar><h3>Popular</h3><p>One two three four five six.</p></div>", "<noscript><p>Enable scripts.</p></noscript>",
    "<section class='comments'><article class=comment><p>First! Great text, I read it all twice.</p></article></section>", "<div hidden><p>unseen</p></div>",
]


@pytest.mark.parametrize("seed", range(60))
def test_articles_among_their_surroundings(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    blocks = [say(rng.choice((1, 3, 12, 60))) + rng.choice(("", " & co", " < 5")) for _ in range(rng.randint(1, 12))]
    body = []
    for i, b in enumerate(blocks):
        tag = "h2" if rng.random() < 0.2 else "li" if rng.random() < 0.1 else "p"
        words = html.escape(b).split(" ")
        words[0] = f"<b>{words[0]}</b>" if rng.random() < 0.3 else words[0]
        body.append(f"<{tag}>" + rng.choice((" ", "\n  ", "&nbsp;", "\t")).join(words) + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"))
        if rng.random() < 0.25:
            body.append(rng.choice(CHROME))
        if rng.random() < 0.15 and i:
            body.append("<div><figure><img src=x></figure></div>")
    around = [rng.choice(CHROME) for _ in range(6)]
    tag = rng.choice(("article", "main", "div itemprop='articleBody'"))
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body class='has-sidebar'><header><h1>The Site</h1></header>{''.join(around[:3])}<div class='page with-sidebar'><{tag}>{''.join(body)}</{tag.split()[0]}>{''.join(around[3:])}</div><footer>© us</footer>"
    assert main_text(page) == "\n".join(" ".join(b.split()) for b in blocks)


def test_pages_without_a_marked_article():
    long = "a long paragraph of text " * 12
    page = f"<div><ul><li><a href=x>Home</a><li><a>News</a></ul></div><div><h1>Title</h1><p>{long}<p>Short.<p>{long}</div><div><div><div><p>hint</p></div></div></div>"
    assert main_text(page) == f"Title\n{long.strip()}\nShort.\n{long.strip()}"
    assert main_text("just text") == "just text" and main_text("<p>a < b <3 > c") == "a < b <3 > c"


@pytest.mark.parametrize(
    "page,want",
    [(None, ""), ("", ""), ("   ", ""), ("<article></article><nav>x</nav>", ""), ("<p>x<!-- y", "x"), ("<p>x<script>y", "x"), ("<p>x<a href='", "x"), ("<article>a<p>b", "a\nb"),
     ("<p>&#99999999999999999999;&eacute;&lt;p&gt;", "�é<p>"), ("<article><p>one<br>two<p title='a>b'> a\n  b<td>1</td></article>", "one two\na b\n1"), ("</p></div><p>x</b>", "x")],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_broken_markup_takes_linear_time():
    for page in ("<div>" * 100_000, "<a '" * 100_000, "</p>" * 100_000, "<p>x" * 100_000, "<" * 300_000, "<div class=ad>" * 50_000 + "<article>x", "&#1" * 100_000, "<!--" * 100_000):
        start = time.time()
        main_text(page)
        assert time.time() - start < 10, page[:20]


def test_surges_and_dives():
    assert runs([5, 0, 7, 9], [3, 3, 1, 0]) == [(0, 1, 5), (2, 4, 16)]
    assert runs([5, 7], [0, 2]) == [(0, 2, 7)] and runs([5, 7], [0, 3]) == [(0, 1, 5), (1, 2, 7)] and runs([], []) == []


def test_every_column_is_kept(spark):
    df = spark.createDataFrame([(1, "<p>a", "u", "m"), (None, None, None, None), (1, "<p>a", "u", "m")], "page_id int, html string, url string, main_text string")
    out = extract_main(df)
    assert out.columns == ["page_id", "html", "url", "main_text", "main_text_"]
    assert sorted((r["main_text"] or "", r["main_text_"]) for r in out.collect()) == [("", ""), ("m", "a"), ("m", "a")]
    assert main_texts(df.limit(0)).count() == 0
    assert {(r.page_id, r.text, r.n_chars) for r in main_texts(df).collect()} == {(1, "a", 1), (None, "", 0)}


# --- centroids ------------------------------------------------------------------------------


def plain_lloyd(rows, k=16, rounds=3, dims=64):
    good = [(i, [max(-(1 << 27), min(1 << 27, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)
    cs = [v for _, v in order[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs)) for _, v in good]
        if step < rounds:
            for n in range(len(cs)):
                own = [v for (_, v), (_, c) in zip(good, near, strict=True) if c == n]
                if own:
                    cs[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for d, c in near if c == n) for n in range(len(cs))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((str(i), c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(good, near, strict=True))


def collected(df):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in df.collect())


def test_rounds_equal_whole_numbers(spark):
    rng = random.Random(2)
    centre = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(round(c + rng.gauss(0, 0.2), 3)) for c in centre[i % 5]]) for i in range(200)]
    rows += [(7, rows[7][1]), (None, rows[1][1]), (900, None), (901, [float("nan")] * 64), (902, [1.0] * 63), (903, [float("inf")] * 64), (904, [None] + [0.0] * 63), (905, [1e30] * 64), (906, []), (907, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, v string").repartition(5)
    assert collected(centroids.cluster_vectors(df)) == plain_lloyd(rows)


def test_few_equal_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    same = [("a", [0.5] * 64)] * 40 + [("b", [0.25] * 64)]
    assert collected(centroids.cluster_vectors(make(same))) == plain_lloyd(same)
    assert centroids.cluster_vectors(make([])).count() == 0
    assert centroids.cluster_vectors(make([("a", [1.0])])).count() == 0
    assert centroids.cluster_vectors(make([(None, [0.5] * 64)])).count() == 0  # nothing that could be a first centroid


def test_centroids_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted((str(r[0]), *r[1:]) for r in con.execute(ORACLES["op13_centroids"]).fetchall())
    assert collected(centroids.cluster_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))) == want
