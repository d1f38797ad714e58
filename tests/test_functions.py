from datetime import datetime

from pyspark.sql import functions as F

from tidewire.functions import dates, html, numbers, text
from tidewire.operators import rules


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_tokens_and_stems(spark):
    got = one(
        spark,
        text.tokens(F.lit("Россия приостановит поставки газа в Армению на 11 дней")),
        text.tokens(F.lit("Ёж и ёлка")),
        text.stem(F.lit("санкциями")),
        text.stem(F.lit("газа")),
        text.stem(F.lit("word")),
    )
    assert got == (["приостанов", "поставк", "газа", "армени", "дней"], ["елка"], "санкц", "газа", "word")


def test_unicode_space_and_edges(spark):
    nbsp = chr(0xA0)
    got = one(spark, text.strip(F.lit(f"{nbsp} a b{chr(0xFEFF)}\n")), text.squeeze(F.lit(f"a{nbsp} \t b")), F.lit("пришел по делу").rlike(rules.spelled("@по@")))
    assert got == ("a b", "a b", False)


def test_trim_excerpt(spark):
    long = "слово " * 100
    hard = "x" * 600
    got = one(spark, text.trim_excerpt(F.lit(long)), text.trim_excerpt(F.lit(hard)), text.trim_excerpt(F.lit(" short ")), text.trim_excerpt(F.lit(None).cast("string")))
    assert got[0] == ("слово " * 83).strip() + "…"
    assert got[1] == "x" * 500 + "…"
    assert got[2:] == ("short", "")


def test_urls(spark):
    got = one(
        spark,
        text.url_section(F.lit("https://tass.ru/Politika/28093215")),
        text.url_section(F.lit("https://www.sport-interfax.ru/1113950")),
        text.url_section(F.lit("not a url")),
        text.safe_url(F.lit("ftp://x")),
        text.safe_url(F.lit("https://a.b/c d")),
        text.host_of(F.lit("https://User@Habr.com:80/x")),
        text.item_id(F.lit("https://a")),
    )
    assert got[:6] == ("politika", "1113950", "", "", "https://a.b/c d", "habr.com") and len(got[6]) == 16


def test_paragraphs_and_escape(spark):
    got = one(spark, text.paragraphs_to_html(F.lit("A.  B <x>\n\nC & \"d\" 'e'")), text.escape_html(F.lit("&<>\"'")))
    assert got == ("<p>A.</p><p>B &lt;x&gt;</p><p>C &amp; &quot;d&quot; &#039;e&#039;</p>", "&amp;&lt;&gt;&quot;&#039;")


def test_redact(spark):
    cases = {
        "ghp_" + "a" * 36: "[redacted]",
        "https://u:p@h/x": "https://[redacted]@h/x",
        "https://h/?a=1&token=abc&b=2": "https://h/?a=1&token=[redacted]&b=2",
        'token = "0c497b5014f705c0be648d68b816f88c209136eb"': 'token = "[redacted]"',
        "nothing to see": "nothing to see",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", text.redact("x").alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_media(spark):
    node = lambda t, m, u: F.struct(F.lit(t).cast("string").alias("type"), F.lit(m).cast("string").alias("medium"), F.lit(u).alias("url"))
    media = F.array(node("audio/mp3", None, "https://a/1"), node(None, "video", "https://a/2"), node("image/png", None, "https://a/3"))
    none = F.array().cast("array<struct<type:string,medium:string,url:string>>")
    body = F.lit('<p><img class="x" src="https://a/4"></p>')
    got = one(spark, text.item_image(media, F.lit("https://a/5"), [body]), text.item_image(none, F.lit("x"), [body]), text.item_image(none, F.lit("https://a/5"), [body]))
    assert got == ("https://a/3", "https://a/4", "https://a/5")


def test_numbers(spark):
    cases = ["312,4", "1e3", " 5 ", "", None, "abc", "1,000,0", "inf", "-.5"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string").select("i", numbers.num(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [312.4, 1000.0, 5.0, None, None, None, None, None, -0.5]


def test_round2(spark):
    cases = [1.005, 0.125, -0.125, 2.675, 0.004, None]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x double").select("i", numbers.round2(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [1.0, 0.13, -0.13, 2.67, 0.0, None]


def test_round2_is_exact(spark):
    """Against decimal arithmetic on the exact binary value: ties, near ties, small and large numbers."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(1)
    cases = [rng.randint(-10**6, 10**6) / 1000 for _ in range(3000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 12) for _ in range(3000)]
    cases += [k / 200 for k in range(-400, 401)] + [k / 8 for k in range(-80, 81)] + [2.0**52 + 1, -(2.0**53), 1e300, 0.005, -0.005, 0.0]
    want = [float(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) if abs(x) < 1e20 else x for x in cases]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, x double").select("i", numbers.round2("x").alias("n")).orderBy("i").collect()
    assert [(c, r.n) for c, r in zip(cases, rows, strict=True)] == list(zip(cases, want, strict=True))
    assert all(str(r.n) != "-0.0" for r in rows)


def test_formats(spark):
    got = one(spark, numbers.format_money(F.lit(1.25e9)), numbers.format_money(F.lit(3e6)), numbers.format_change(F.lit(-0.5)), numbers.heat_step(F.lit(-4.0)), numbers.heat_step(F.lit(0.09)), numbers.plural(F.lit(12), "a", "b", "c"))
    assert got[1:] == ("3 млн ₽", "−0,50%", "d5", "zero", "c") and got[0].endswith(" млрд ₽")


def test_dates(spark):
    got = one(
        spark,
        dates.published_at(F.lit("Wed, 09 Sep 2026 12:00:00 GMT")),
        dates.published_at(F.lit("9 Sep 2026 15:00:00 +0300")),
        dates.published_at(F.lit(""), F.lit("2026-09-09T12:00:00Z")),
        dates.published_at(F.lit("soon")),
    )
    assert got == (datetime(2026, 9, 9, 12),) * 3 + (None,)


def test_exchange_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    got = one(spark, dates.brent_contracts(ts("2026-09-09")), dates.brent_contracts(ts("2026-12-30")), *[dates.session_by_clock(ts(s)) for s in ("2026-09-09 12:00", "2026-09-09 15:55", "2026-09-09 20:00", "2026-09-12 12:00")])
    assert got == (["BRU6", "BRV6", "BRX6"], ["BRZ6", "BRF7", "BRG7"], "open", "closed", "open", "closed")
    interval, start, till = dates.candle_bounds("day", ts("2026-09-09"))
    assert (interval, *one(spark, start, till)) == (10, "2026-09-02", "2026-09-09")
    interval, start, till = dates.candle_bounds("ytd", ts("2026-09-09"))
    assert (interval, *one(spark, start, till)) == (24, "2026-01-01", "2026-09-09")


def test_html_columns(spark):
    page = '<p onclick="x">Hi <a href="/a" target="_top">b</a></p><script>bad()</script><h1>t</h1><img src="javascript:1" alt="q">'
    got = one(spark, html.strip_html(F.lit("<p>a&amp;</p>  <b>b</b>")), html.sanitized(F.lit(page)), html.sanitized_for_reader(F.lit(page)))
    assert got[0] == "a& b"
    assert got[1].html == '<p>Hi <a href="/a">b</a></p>t<img src="javascript:1" alt="q">' and not got[1].truncated
    assert "script" not in got[2].replace("javascript", "") and "onclick" not in got[2] and "javascript" not in got[2]
    assert one(spark, html.sanitized_for_reader(F.lit('<a href="https://x" onclick="1">y</a>')))[0] == '<a href="https://x" target="_blank" rel="noreferrer noopener">y</a>'


def test_truncation():
    body = "<p>aaa</p>" * 5
    assert html.sanitize(body, 2) == ("<p>aaa</p><p>aaa</p>", True, 6, 2)
    assert html.sanitize(body, 99, 4) == ("<p>aaa</p><p>aaa</p>", True, 6, 2)
    assert html.sanitize(None) == ("", False, 0, 0)


def test_pictures_and_bodies():
    assert html.page_picture('<meta name="twitter:image" content="/t"><meta property="og:image" content="/a.png">', "https://e.x/b/c") == "https://e.x/a.png"
    assert html.page_picture("<p>", "https://e.x") == ""
    long = "word " * 60
    page = '<script type="application/ld+json">oops</script><script type="application/ld+json">{"@graph":[{"hasPart":{"articleBody":"%s"}}]}</script>' % long
    assert html.structured_body(page) == long.strip()
    content, text_, _, _ = html.extract_article(page + "<p>short</p>", "https://e.x")
    assert content == f"<p>{long.strip()}</p>" and text_ == long.strip()
    habr = '<h1>T</h1><div class="article-formatted-body"><pre class="x"><code>c</code></pre></div>'
    assert html.extract_article(habr, "https://habr.com/ru/1")[0] == '<pre class="x"><code>c</code></pre>'


def test_articles_without_paragraphs():
    """Lines that stand in a div alone, beside a menu, comments and a footer."""
    menu = "<nav><ul>" + "".join(f'<li><a href="/{i}">Section {i} of this site</a></li>' for i in range(9)) + "</ul></nav>"
    rest = '<div class="talk"><p>I agree with all of it</p><p>So do I, and more</p></div><footer><p>Rights. <a href="/a">About this site of ours</a></p></footer>'
    lines = "The harbour froze <b>early</b> this year.<br>Boats stay <a href='/x'>ashore</a> until the thaw, says its master, who has seen worse."
    for body in (f"<div>{lines}</div>", f"<article><section>{lines}<p>A last word of it.</p></section></article>", f"<table><tr><td>{lines}</td></tr></table>"):
        _, found, _, _ = html.extract_article(f"<html><body>{menu}<main><h1>t</h1>{body}{rest}</main></body></html>", "https://e.x")
        assert found.startswith("The harbour froze early") and "agree" not in found and "Section" not in found


def test_display_date(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, dates.display_date(ts("2026-09-09 15:04:05")), dates.display_date(ts("2026-05-31 00:00")), dates.display_date(ts(None))) == ("9 сент. 2026 г., 15:04", "31 мая 2026 г., 00:00", "")


def test_markers(spark):
    got = one(spark, text.page_markers(F.lit('<script type="application/ld+json"></script><article>Just a moment')), text.page_markers(F.lit("plain")))
    assert got == (["ld+json", "<article>", "challenge"], [])
