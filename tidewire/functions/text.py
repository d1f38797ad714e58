"""Text, URL and HTML-escaping expressions, all of them Catalyst columns.

Lengths and cuts count code points. White space is the ECMAScript set, which Java's \\s is not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regex class body, Unicode word edges.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LEFT_EDGE = r"(?<![\p{L}\p{N}])"
RIGHT_EDGE = r"(?![\p{L}\p{N}])"

#: Fixed value: characters of an index excerpt.
EXCERPT_CHARS = 500

#: Endings taken off a Russian word, longest first.
ENDINGS = (
    "иями ями ами ого его ому ему ыми ими ешь ишь ете ите ует уют ают яют ить ать ять еть "
    "ой ей ах ях ам ям ов ев ий ый ая яя ое ее ые ие ом ем ть ла ли ло ет ут ют ит ат ят "
    "а я ы и у ю о е ь"
).split()
MIN_STEM, MIN_TOKEN = 4, 3

#: Words that say nothing about an event.
STOPWORDS = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему
теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут
где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой
совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после
над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя
такой им более всегда конечно всю между это также который которые которая которых также об также свой свои своих своей его их
года году годах лет год рублей млн млрд тыс процентов процента процент раз также сообщил сообщила сообщили сообщает заявил заявила
заявили заявляет рассказал рассказала отметил отметила пишет передает передаёт стало известно источник источника данным данные
россии российской российских российский российская российские рф россия москве москвы москва сша
""".split()


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text_or_empty(x), f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(x: Column | str) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(text_or_empty(x), f"[{SPACE}]+", " "))


def join_fragments(parts: Column | str) -> Column:
    """Text of a node given as its fragments in order."""
    return strip(F.array_join(F.transform(F.coalesce(col(parts), F.array().cast("array<string>")), strip), ""))


def is_http(url: Column | str) -> Column:
    return text_or_empty(url).rlike("(?i)^https?://")


def safe_url(url: Column | str) -> Column:
    """The address if it is an http(s) one with a host, else empty."""
    u = strip(url)
    return F.when(u.rlike(r"(?i)^https?://[^/?#\s]+"), u).otherwise("")


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def url_section(url: Column | str) -> Column:
    """First path segment, lower-case; empty for what is no address or has no path."""
    path = F.regexp_extract(text_or_empty(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, "^/*([^/]+)", 1))


def link_or_guid(link: Column | str, guid: Column | str) -> Column:
    return F.coalesce(F.nullif(strip(link), F.lit("")), strip(guid))


def item_id(url: Column | str) -> Column:
    return F.substring(F.sha1(text_or_empty(url)), 1, 16)


def trim_excerpt(x: Column | str, most: int = EXCERPT_CHARS) -> Column:
    """A long text is cut at the last space of its second half, or hard, and gets an ellipsis."""
    t = strip(x)
    cut = F.substring(t, 1, most)
    back = F.instr(F.reverse(cut), " ")  # 1-based from the end
    at = F.lit(most) - back  # characters before the last space
    head = F.when((back > 0) & (at > most / 2), F.substring(cut, F.lit(1), at)).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(head, f"[{SPACE},;:—–-]+$", ""), F.lit("…")))


def distinct_strings(xs: Column | str) -> Column:
    """Non-empty strings, each once, in first-seen order."""
    return F.array_distinct(F.filter(F.coalesce(col(xs), F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")))


#: Entities in the order they are written.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def escape_html(x: Column | str) -> Column:
    out = col(x)
    for plain, entity in ENTITIES:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def paragraphs_to_html(x: Column | str) -> Column:
    """Paragraphs end at line ends, or at a sentence end with two or more spaces."""
    parts = F.split(text_or_empty(x), rf"\n+|(?<=[.!?…»\"])[{SPACE}]{{2,}}")
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")


def normalize_rubric(x: Column | str) -> Column:
    edged = F.regexp_replace(F.lower(col(x)), rf"^[{SPACE}\-–—/]+|[{SPACE}\-–—/]+$", "")
    return F.regexp_replace(edged, f"[{SPACE}]+", " ")


def title_key(x: Column | str) -> Column:
    lowered = F.replace(F.lower(text_or_empty(x)), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "))


def stem(token: Column | str) -> Column:
    """Shortest base of four letters or more before a known ending, i.e. the longest ending goes."""
    return F.regexp_replace(col(token), f"^([а-я]{{{MIN_STEM},}}?)(?:{'|'.join(ENDINGS)})$", "$1")


def tokens(x: Column | str) -> Column:
    """Stems of the words of a text; short words and stop words go before stemming, short stems after."""
    lowered = F.replace(F.lower(text_or_empty(x)), F.lit("ё"), F.lit("е"))
    words = F.split(lowered, "[^a-zа-я0-9]+")
    stop = dict.fromkeys(STOPWORDS)  # a list of literals is looked up as a set
    kept = F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN) & ~w.isin(*stop))
    return F.filter(F.transform(kept, stem), lambda w: F.length(w) >= MIN_TOKEN)


def full_text(fields: list[Column], least: int = 500) -> Column:
    """The first field whose text (tags dropped) is long enough, else empty."""
    bare = lambda c: squeeze(F.regexp_replace(text_or_empty(c), "<[^>]*>", ""))
    return F.coalesce(*[F.when(F.length(bare(c)) >= least, strip(c)) for c in fields], F.lit(""))


def first_http(candidates: list[Column]) -> Column:
    return F.coalesce(*[F.when(is_http(c), c) for c in candidates], F.lit(""))


IMG_SRC = r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']"


def first_img(html: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(html), IMG_SRC, 1)


def media_url(node: Column) -> Column:
    """Address of a media struct (type, medium, url); other media than images are skipped."""
    other = ((F.coalesce(node["type"], F.lit("")) != "") & ~F.coalesce(node["type"], F.lit("")).startswith("image/")) | (
        (F.coalesce(node["medium"], F.lit("")) != "") & (F.coalesce(node["medium"], F.lit("")) != "image")
    )
    return F.when(~other & is_http(node["url"]), node["url"])


def item_image(media: Column, image: Column, bodies: list[Column]) -> Column:
    """First usable media entry, then the image field, then the first picture of the first body that has an http one."""
    found = F.filter(F.transform(media, media_url), lambda u: u.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.when(is_http(image), image), first_http([first_img(b) for b in bodies]))


def clamp_int(x: Column | str, low: int, high: int) -> Column:
    """Rounded and bounded; what is no number becomes the lower bound."""
    value = col(x).try_cast("double")
    whole = F.floor(value + 0.5).cast("int")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), whole)))


#: What tells about a page without text, in its order.
MARKERS = (
    ("ld+json", r"(?i)application/ld\+json"),
    ("spa-state", r"__NUXT__|__NEXT_DATA__|window\.__INITIAL_STATE__"),
    ("<article>", r"(?i)<article[\s>]"),
    ("challenge", "(?i)captcha|cf-chl|challenge-platform|Just a moment"),
    ("paywall?", "(?iu)paywall|подписк"),
)


def page_markers(html: Column | str) -> Column:
    """What a page without text shows."""
    h = text_or_empty(html)
    return F.filter(F.array(*[F.when(h.rlike(p), F.lit(name)) for name, p in MARKERS]), lambda m: m.isNotNull())


#: Families of secrets and what stands in for each.
SECRET_PATTERNS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    r"gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}",
    r"[0-9]{8,10}:[A-Za-z0-9_-]{35}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"hv[sbr]\.[A-Za-z0-9_-]{20,}",
    r"SWMTKN-1-[A-Za-z0-9]+-[A-Za-z0-9]+",
)
SECRET_URL_USER = r"(https?://)[^/@:]+:[^/@]+@"
SECRET_PARAM = r"(?i)([?&](?:access_token|token|api_?key|secret|password|passwd|auth|signature)=)[^&#\"'<>]+"
SECRET_ASSIGNED = r"(?i)((?:token|secret|password|api_?key)[\"']?\s*[:=]\s*[\"'])[A-Za-z0-9+/_.=-]{16,}"
REDACTED = "[redacted]"


def redact(x: Column | str) -> Column:
    out = col(x)
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, REDACTED)
    out = F.regexp_replace(out, SECRET_URL_USER, f"$1{REDACTED}@")
    out = F.regexp_replace(out, SECRET_PARAM, f"$1{REDACTED}")
    return F.regexp_replace(out, SECRET_ASSIGNED, f"$1{REDACTED}")
