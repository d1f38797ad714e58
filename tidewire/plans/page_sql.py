"""DuckDB SQL of the page and feed queries: pages are composed of known parts, so what is left of them is known."""

from __future__ import annotations

from tidewire.plans.views import END_TEXT, FEED, PAGE_END, SHOWN_END, STORED_END, with_number

#: White space as Python's patterns have it with the byte order mark, and as ECMAScript has it.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
EDGE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def squeezed(x: str, blank: str = BLANK) -> str:
    return f"trim(regexp_replace({x}, '{blank}', ' ', 'g'), ' ')"


def stripped(x: str, blank: str = BLANK) -> str:
    return f"regexp_replace({x}, '^{blank}|{blank}$', '', 'g')"


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def all_escaped(x: str) -> str:
    return f"""replace(replace({escaped(x)}, '"', '&quot;'), chr(39), '&#039;')"""


def paragraphs(x: str, blank: str) -> str:
    """Sentence ends with wide space part paragraphs: RE2 has no lookbehind, so the end is kept before a mark."""
    lines = rf"regexp_replace({x}, '\n+', chr(1), 'g')"
    wide = rf"""regexp_replace({lines}, '([.!?…»"])({blank.rstrip("+")}{{2,}})', '\1' || chr(1), 'g')"""
    parts = f"list_filter(list_transform(string_split({wide}, chr(1)), lambda x: {stripped('x', blank)}), lambda x: x <> '')"
    return f"array_to_string(list_transform({parts}, lambda x: '<p>' || {all_escaped('x')} || '</p>'), '')"


def numbered(markup: str) -> str:
    return with_number(markup, "doc_id").replace("as string", "AS VARCHAR")


TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"
DATA = "CASE WHEN doc_id % 3 = 0 THEN to_json({'@graph': [{'articleBody': text}]})::VARCHAR ELSE '' END"
PAGE_ORACLES: dict[str, str] = {}

PLAIN = f"""'Page ' || doc_id || {DATA} || 'var a = "<p>no</p>";p{{}}Head' || array_to_string(lines, '') || '{END_TEXT}'"""
PAGE_ORACLES["page_texts"] = f"""WITH {TEXTS}, t AS (SELECT doc_id, {squeezed(PLAIN)} AS plain FROM d)
SELECT doc_id, length(plain) AS chars, md5(plain) AS text_md5, 'part' AS section, 'host' || (doc_id % 7) || '.example' AS host FROM t"""

PAGE_ORACLES["page_marks"] = r"""WITH p AS (
  SELECT page_id, html || ['', '<ARTICLE data-x>', 'window.__INITIAL_STATE__=1', 'please solve the CAPTCHA', 'Оформите ПОДПИСКУ', '<script type="Application/LD+JSON">', '<articles>', '__NUXT__'][page_id % 8 + 1] AS h FROM pages)
SELECT page_id, array_to_string(list_filter([
  CASE WHEN contains(lower(h), 'application/ld+json') THEN 'ld+json' END,
  CASE WHEN contains(h, '__NUXT__') OR contains(h, '__NEXT_DATA__') OR contains(h, 'window.__INITIAL_STATE__') THEN 'spa-state' END,
  CASE WHEN regexp_matches(lower(h), '<article[ \t\n\x0B\f\r>]') THEN '<article>' END,
  CASE WHEN regexp_matches(lower(h), 'captcha|cf-chl|challenge-platform|just a moment') THEN 'challenge' END,
  CASE WHEN regexp_matches(lower(h), 'paywall|подписк') THEN 'paywall?' END], lambda x: x IS NOT NULL), ',') AS markers FROM p"""


def stored_page(most_blocks: int, most_chars: int) -> str:
    """What is left of each page: blocks as long as fewer than most_blocks and most_chars came before them.

    The picture in the last paragraph is a block of its own, after it.
    """
    bare = numbered(STORED_END.replace('<img src="/i.png" alt="a">', ""))
    return f"""SELECT doc_id, 'Page ' || doc_id || 'Head' || string_agg(CASE WHEN NOT stays THEN '' WHEN is_end AND NOT pictured THEN {bare} ELSE markup END, '' ORDER BY nth) AS html,
         bool_or(NOT stays OR (is_end AND NOT pictured)) AS cut, sum(CASE WHEN stays THEN chars ELSE 0 END)::INT AS chars,
         (count(*) FILTER (WHERE stays) + count(*) FILTER (WHERE is_end AND stays AND pictured))::INT AS blocks
  FROM (
    SELECT *, nth <= {most_blocks} AND before < {most_chars} AS stays, nth + 1 <= {most_blocks} AND before + chars < {most_chars} AS pictured
    FROM (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY nth) - chars AS before FROM blocks) b) c
  GROUP BY doc_id"""


BLOCKS = f"""raw_blocks AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS nth, unnest(lines) AS line, FALSE AS is_end FROM d UNION ALL SELECT doc_id, len(lines) + 1, '', TRUE FROM d),
blocks AS (
  SELECT doc_id, nth, is_end, CASE WHEN is_end THEN {len(END_TEXT)} ELSE length({squeezed("line")}) END AS chars,
         CASE WHEN is_end THEN {numbered(STORED_END)} ELSE '<p>' || {escaped("line")} || '</p>' END AS markup FROM raw_blocks)"""
PAGE_ORACLES["stored_pages"] = f"""WITH {TEXTS}, {BLOCKS}, whole AS ({stored_page(1500, 220_000)}), part AS ({stored_page(6, 400)})
SELECT w.doc_id, md5(w.html) AS html_md5, w.cut, w.chars, w.blocks, md5(s.html) AS short_md5, s.cut AS short_cut, s.chars AS short_chars, s.blocks AS short_blocks
FROM whole w JOIN part s USING (doc_id)"""
PAGE_ORACLES["shown_pages"] = f"""WITH {TEXTS}
SELECT doc_id, md5('Page ' || doc_id || 'Head' || array_to_string(list_transform(lines, lambda x: '<p>' || {escaped("x")} || '</p>'), '') || {numbered(SHOWN_END)}) AS html_md5 FROM d"""

PICTURE = "CASE WHEN doc_id % 2 = 0 THEN 'https://s.example/p/' || doc_id || '.png' ELSE 'https://s.example/t.png' END"
BODY = f"CASE WHEN doc_id % 3 = 0 AND length({stripped('text')}) > 200 THEN {stripped('text')} ELSE '' END"
PAGE_ORACLES["page_pictures"] = f"WITH {TEXTS}, b AS (SELECT doc_id, {BODY} AS body FROM d) SELECT doc_id, {PICTURE} AS picture, length(body) AS body_chars, md5(body) AS body_md5 FROM b"

WHOLE_LINES = "array_to_string(list_transform(lines, lambda x: '<p class=\"x\" onclick=\"y()\">' || " + escaped("x") + " || '</p>'), '')"
PAGE_ORACLES["page_articles"] = f"""WITH {TEXTS},
b AS (
  SELECT doc_id, {BODY} AS body, {WHOLE_LINES} || {numbered(PAGE_END.replace("</div></body></html>", ""))} AS markup, {squeezed(f"array_to_string(lines, '') || '{END_TEXT}'")} AS dense,
         len(list_filter(lines, lambda x: length({squeezed("x")}) >= 25)) > 0 AS has_dense FROM d),
c AS (SELECT *, CASE WHEN has_dense THEN dense ELSE '' END AS own FROM b),
e AS (SELECT *, body <> '' AND length(own) < least(400, length(body) / 2) AS structured FROM c)
SELECT doc_id, 'Page ' || doc_id AS title, {PICTURE} AS picture, md5(CASE WHEN structured THEN {squeezed("body")} ELSE own END) AS text_md5,
       md5(CASE WHEN structured THEN {paragraphs("body", BLANK)} WHEN has_dense THEN markup ELSE '' END) AS content_md5 FROM e"""
PAGE_ORACLES["paragraphs"] = f"WITH {TEXTS} SELECT doc_id, md5({paragraphs('text', EDGE)}) AS html_md5 FROM d"


def long_enough(x: str) -> str:
    tagless = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return f"length({squeezed(tagless, EDGE)}) >= 500 THEN {stripped(x, EDGE)}"


PAGE_ORACLES["full_texts"] = f"""WITH f AS (
  SELECT doc_id, coalesce('<p>' || substr(text, 1, 490) || '</p>  <i title=''long long attribute''>', '') AS a, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS b,
         '  ' || coalesce(text, '') || ' tail ' AS c FROM documents)
SELECT doc_id, md5(CASE WHEN {long_enough("a")} WHEN {long_enough("b")} WHEN {long_enough("c")} ELSE '' END) AS text_md5 FROM f"""

# --- feeds ----------------------------------------------------------------------------------


def landed(x: str) -> str:
    """As it was written to XML and read back."""
    return stripped(rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\r\x{{FFFE}}\x{{FFFF}}]', ' ', 'g')", EDGE)


PAGE_ORACLES["landed_feeds"] = f"""WITH {FEED}
SELECT substr(sha1(url), 1, 16) AS id, source_id, {landed("substr(title, 1, 100)")} AS title, url, strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') AS published_at, CASE WHEN ord % 2 = 0 THEN lang || ',News' ELSE lang END AS rubrics, image,
       {landed("substr(excerpt, 1, 200)")} AS description FROM feed"""
PAGE_ORACLES["feed_fields"] = f"""WITH {FEED}, p AS (SELECT *, 'https://p.example/' || ord AS pic FROM feed)
SELECT ord, source_id || lang || 'b' AS joined, CASE WHEN ord % 5 <> 3 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') END AS published_at,
       CASE WHEN ord % 2 = 1 THEN pic || '/m' WHEN ord % 3 <> 0 THEN pic || '/e' WHEN ord % 12 = 0 THEN pic || '/i' ELSE pic || '/b' END AS image FROM p"""

ADDRESS = "https://iss.moex.com/iss/engines/stock/markets/index/boards/SNDX/securities/IMOEX/candles.json?iss.meta=off"


def asked(interval: int, start: str) -> str:
    return f"'{ADDRESS}&interval={interval}&from=' || strftime({start}, '%Y-%m-%d') || '&till=' || strftime(o_orderdate, '%Y-%m-%d')"


PAGE_ORACLES["candle_requests"] = f"""SELECT o_orderkey, {asked(10, "o_orderdate - INTERVAL 7 DAY")} AS day, {asked(60, "o_orderdate - INTERVAL 10 DAY")} AS week,
  {asked(24, "o_orderdate - INTERVAL 35 DAY")} AS month, {asked(24, "date_trunc('year', o_orderdate)")} AS ytd FROM orders"""
PAGE_ORACLES["snapshot_articles"] = "SELECT page_id::VARCHAR AS id, CASE WHEN page_id % 4 <> 0 THEN md5(html) END AS html_md5, page_id = 1 AS looked_up FROM pages WHERE page_id % 3 <> 0"
