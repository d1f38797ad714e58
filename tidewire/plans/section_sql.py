"""The section rules once more, written by hand for DuckDB's RE2 from the rules' fixed values, so that a slip in the
library's patterns shows.

RE2's \\b is an ASCII word edge. What must not follow a term is blanked before the test; a Unicode word edge
consumes the neighbour, which is right for existence.
"""

from __future__ import annotations

AI_PATTERN = (
    r"искусственн(ый|ого|ому|ым|ом) интеллект|нейросет|нейронн(ая|ые|ой|ую) сет|генеративн(ый|ого|ому|ым|ом) ии"
    r"|машинн(ое|ого|ому|ым|ом) обучен|больш(ая|ой|ую|ие|их) языков(ая|ой|ую|ые|ых) модел|вайб-?кодинг"
    r"|(^|[^а-яёa-z0-9])ии($|[^а-яёa-z0-9])"
    r"|\bartificial intelligence\b|\bgenerative ai\b|\bmachine learning\b|\bdeep learning\b|\blarge language models?\b|\bllms?\b|\bml\b|\bvibe coding\b"
    r"|\bchatgpt\b|\bopenai\b|\banthropic\b|\bclaude (ai|[0-9]|model)\b|(модель|model)\s+claude\b|\bgoogle gemini\b|(модель|model)\s+gemini\b|\bgemini (ai|[0-9])\b"
    r"|\bgpt-?[0-9]|\b(qwen|llama|deepseek|mistral|gemma|grok)([0-9]|\b)|\bcopilot\b|\bmidjourney\b|\bstable diffusion\b|\bai[- ]agents?\b"
)

HEALTH_PATTERN = (
    r"\bhealth\b|\bmedicine\b|здоров|медиц|врач|пациент|больниц|клиник|аптек|лекарств|препарат|вакцин|диабет|ожирен|онколог"
    r"|инфекц|грипп|коронавирус|covid|фарма|психолог|психиатр|депресс|стресс|инсульт|инфаркт|бессонниц|симптом|заболеван"
)

SECURITY_PATTERN = (
    r"кибер(атак|преступ|безопасност|угроз|шпион|мошенн|инцидент|войн|развед|полиц|расслед|защит)|хакер|уязвимост|вредонос"
    r"|малвар|шифровальщик|фишинг|эксплойт|ботнет|троян|бэкдор|руткит|антивирус|пентест|инфобез|даркнет"
    r"|информационн(ая|ой|ую) безопасност|утечк[а-я]* (данных|персональн|баз|информац|парол)"
    r"|\bddos\b|\bmalware\b|\bransomware\b|\bspyware\b|\brootkit\b|\bphishing\b|\bcve-[0-9]{4}-[0-9]+|\bzero-day\b|\b0-day\b"
    r"|\binfostealer|\bdata breach|\bcyber ?(attack|security|crime|threat|espionage)|\bhackers?\b|\bhacked\b"
    r"|\bbotnet\b|\bbackdoor\b|\bweb shell\b|\bdark ?web\b|\bcredential (theft|stuffing)|\binfosec\b"
)
SECURITY_HINT = r"взлом|вымогател|\bexploit|\bvulnerabilit|\bbreach"
DIGITAL = (
    r"аккаунт|учетн(ая|ой|ую) запис|сайт|сервер|систем|баз[а-я]* данных|данны[ех]|парол|телефон|смартфон|компьютер|ноутбук"
    r"|сет[ьи]\b|почт|приложен|мессендж|крипто|бирж|банк|\bпо\b|софт|программ|прошивк|плагин|патч|обновлен|устройств|роутер"
    r"|камер|браузер|\bит\b|\bit\b|windows|linux|android|ios|iphone|chrome|api|wi-?fi|bluetooth|\bsoftware\b|\bservers?\b|\bnetwork"
    r"|\bpassword|\baccounts?\b|\bdevices?\b|\bapps?\b|\brouter|\bdatabase|\bcredential|\bpatch|\bupdate|\bbrowser"
    r"|\bplugin|\bfirmware|\bcloud\b|\bemail\b|\bcrypto"
)

#: Left edge; right edge; rest of a Russian word.
L, R, RU = r"(?:^|[^\p{L}\p{N}])", r"(?:$|[^\p{L}\p{N}])", r"\p{L}*"
TRADING = (
    rf"{L}(мосбирж|моск(овской|овская|овскую) бирж|ммвб|индекс{RU} ртс|фондов{RU} (рынок|рынк|бирж|индекс)|биржев|котировк"
    rf"|дивиденд|облигаци|делистинг|листинг|акционер|трейдер|брокер|фьючерс|опцион|эмитент|депозитарн{RU} расписк"
    rf"|ценны(е|х|ми) бумаг|(обыкновенн|привилегированн){RU} акци|капитализаци|обратн{RU} выкуп акци|уолл-стрит"
    rf"|индекс (мосбирж|доу|насдак|s&p)"
    rf"|(офз|imoex\p{{N}}*|ipo|spo|etf|nasdaq|nyse|ftse|stoxx|nikkei|buyback|s&p ?500|dow jones|hang seng|share price|shareholders?|stock (market|exchange)|wall street){R})"
)
#: What is not meant by a term above or below.
TRADING_BLANKS = ("акционерн", "опциональн", "уолл-стрит ?джорнал", "wall street journal")
CONTEXT_BLANKS = ("акционерн", "ростов")
CONTEXT = (
    rf"{L}(бирж|котиров|акционер|дивиденд|трейдер|брокер|эмитент|капитализац|облигац|фьючерс|офз{R}|подорожал|подешевел|вырос|рост"
    rf"|снижени|падени|снизил|упал|пункт|процент|торгов{RU} сесси|ценны(е|х|ми) бумаг)"
)
NO_TRADING = (
    rf"{L}(акци(я|и|ю|ей) (протеста|неповиновения|памяти|солидарности|устрашения|возмездия)"
    rf"|(протестн|благотворительн|рекламн|террористическ|гуманитарн|экологическ){RU} акци"
    rf"|индекс (массы тела|потребительских цен|цен производителей|промышленн|производств|деловой активности|человеческого развития|счастья|бедности|качества жизни)"
    rf"|протест|митинг|демонстрац|пикет|забастовк|госзакупк|торги по (закупк|аренде)|аукцион по продаже (имущества|земл))"
)
MAYBE_TRADING = rf"{L}(акци(я|и|й|ю|ям|ями|ях){R}|торг(и|ах|ов|ами){R}|бирж|инвестор|рынок (акци|облигац|капитал|ценных бумаг))"
WHOLE_WORDS = "'акция', 'акции', 'акций', 'акцию', 'акциям', 'акциями', 'акциях', 'торги', 'торгах', 'торгов', 'торгами'"

FIRM = r"(ibs|ибс)"
FIRM_SURE = rf"{L}((гк|группа компаний|(групп|компани|холдинг|интегратор){RU})\s+«?{FIRM}{R}|{FIRM}\s+(group|груп|холдинг|россия|экспертиза|софт)|ibs\.ru)"
FIRM_WORK = (
    rf"{L}(ит-|ит{R}|айти|интегратор|аутсорсинг|консалтинг|импортозамещ|цифровизац|цифров|разработ|программн|софт|систем|сервис"
    rf"|заказчик|внедрен|подрядчик|выручк|прибыл|ipo{R}|сотрудник|инженер|software|integrator|outsourcing|consulting)"
)
ILLNESS = (
    rf"{L}(ишемическ|кардиолог|стенокард|болезн{RU} сердца|инфаркт|кишечник|гастроэнтеролог|ischemic|ischaemic|irritable bowel|bowel|cardiac|heart disease)"
)


def has(text: str, pattern: str, blanks: tuple[str, ...] = ()) -> str:
    for b in blanks:
        text = f"regexp_replace({text}, '{b}', '#', 'g')"
    return f"regexp_matches({text}, '{pattern}')"


def ai(title: str, both: str) -> str:
    return f"({has(title, AI_PATTERN)} OR len(regexp_extract_all({both}, '{AI_PATTERN}')) >= 2)"


def health(t: str) -> str:
    return has(t, HEALTH_PATTERN)


def security(t: str) -> str:
    return f"({has(t, SECURITY_PATTERN, ('hackers? news',))} OR ({has(t, SECURITY_HINT)} AND {has(t, DIGITAL)}))"


def ibs(t: str) -> str:
    return f"(NOT {has(t, ILLNESS)} AND ({has(t, FIRM_SURE)} OR ({has(t, L + FIRM + R)} AND {has(t, FIRM_WORK)})))"


def markets_of(table: str, key: str, text: str) -> str:
    """CTEs that end in `market_news` (key, is_markets) for every row of a table.

    The words of texts that hang on a weak term are laid out with their places; a weak term's window
    has 80 characters on both sides, the term itself blanked.
    """
    return f"""market_rules AS (
  SELECT {key} AS key, {text} AS t, {has(text, TRADING, TRADING_BLANKS)} AS sure, {has(text, NO_TRADING)} AS off, {has(text, MAYBE_TRADING)} AS maybe FROM {table}),
market_words AS (
  SELECT key, t, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')) AS word,
         unnest(regexp_split_to_array(t, '[\\p{{L}}\\p{{N}}]+')[:len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'))]) AS gap,
         unnest(range(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+')))) AS i
  FROM market_rules WHERE maybe AND NOT sure AND NOT off),
market_places AS (
  SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY key ORDER BY i) - length(word) + 1 AS spot,
         lag(word) OVER (PARTITION BY key ORDER BY i) || gap AS before
  FROM market_words),
market_terms AS (
  SELECT *, CASE WHEN word IN ({WHOLE_WORDS}) THEN word WHEN starts_with(word, 'бирж') THEN 'бирж' WHEN starts_with(word, 'инвестор') THEN 'инвестор'
                 WHEN word = 'рынок' THEN regexp_extract(substr(t, spot::BIGINT, 80), '^рынок (акци{RU}|облигац{RU}|капитал{RU}|ценных бумаг)') ELSE '' END AS term
  FROM market_places),
market_windows AS (
  SELECT key, substr(t, greatest(spot - 80, 1)::BIGINT, least(80, spot - 1)::BIGINT) || repeat(' ', length(term)) || substr(t, (spot + length(term))::BIGINT, 80) AS w
  FROM market_terms WHERE term <> '' AND NOT (coalesce(before, '') = 'рынок ' AND starts_with(word, 'акци'))),
market_near AS (SELECT DISTINCT key FROM market_windows WHERE NOT {has("w", NO_TRADING)} AND {has("w", CONTEXT, CONTEXT_BLANKS)}),
market_news AS (SELECT key, sure OR (NOT off AND key IN (SELECT key FROM market_near)) AS is_markets FROM market_rules)"""


def by_text(title: str, both: str, is_markets: str) -> str:
    return (
        f"list_filter([CASE WHEN {ai(title, both)} THEN 'ai' END, CASE WHEN {health(both)} THEN 'health' END, "
        f"CASE WHEN {security(both)} THEN 'security' END, CASE WHEN {is_markets} THEN 'markets' END, "
        f"CASE WHEN {is_markets} THEN 'business' END, CASE WHEN {ibs(both)} THEN 'ibs' END], lambda x: x IS NOT NULL)"
    )
