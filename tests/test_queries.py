"""Every query against its SQL in DuckDB, on whole tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidewire.plans.oracles import ORACLES
from tidewire.plans.queries import QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 9)) if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"clean_pages", "reader_pages"}


def test_raw_pages_hold_only_what_is_allowed(spark):
    """What SQL cannot follow: tags and attributes of cleaned raw pages, read by the standard parser."""
    from html.parser import HTMLParser

    from tidewire.functions import html

    class Seen(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tags, self.attributes = set(), []

        def handle_starttag(self, tag, attrs):
            self.tags.add(tag)
            self.attributes += [(tag, *a) for a in attrs]

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html", html.sanitized("html").html.alias("stored"), html.sanitized_for_reader("html").alias("shown")).collect()
    allowed = set("p br b strong i em a img ul ol li h2 h3 blockquote figure figcaption pre code kbd".split())
    for r in pages:
        stored, shown = Seen(), Seen()
        stored.feed(r.stored), shown.feed(r.shown)
        assert stored.tags <= allowed and shown.tags <= allowed
        assert {(t, a) for t, a, _ in stored.attributes} <= {("a", "href"), ("img", "src"), ("img", "alt"), ("code", "class"), ("pre", "class"), ("kbd", "class")}
        assert all(not a.startswith("on") and a != "style" and (a not in ("href", "src") or v.lower().startswith("http")) for _, a, v in shown.attributes)
        assert html.sanitize(r.stored)[0] == r.stored and html.sanitize_shown(r.shown) == r.shown
    assert any(r.stored for r in pages)


def test_entry(spark):
    import __spark_entry__ as entry

    page = entry.entry(spark)
    assert page.count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tidewire"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tidewire.llm" not in path.read_text()
