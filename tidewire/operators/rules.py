"""Fixed values of the section rules: sections, and term patterns.

Patterns are written for lower-cased text. `@` is an ASCII word edge: a mark, as Java's own `\\b` goes by all letters,
and java() has to spell it as a look at the neighbour. `~` after a term is a Unicode word edge on its
right, which has no sign of its own in Java. A rule that is anchored needs a Unicode word edge on the left of each
term. `(?!...)` is what must not follow.
"""

from __future__ import annotations

import re

#: Sections in their order.
SECTIONS = ("world", "ru", "business", "markets", "tech", "ai", "security", "science", "health", "sports", "culture", "ibs")

#: Characters on both sides of a weak market term that are searched for context.
NEARBY = 80

#: The abbreviation with its neighbours, which are part of a match where matches are counted; and without.
AI_LETTERS, AI_WORD = "(?:^|[^а-яёa-z0-9])ии(?:$|[^а-яёa-z0-9])", "(?=ии)(?<![а-яёa-z0-9])ии(?![а-яёa-z0-9])"
AI_TERMS = [
    "искусственн(?:ый|ого|ому|ым|ом) интеллект",
    "нейросет",
    "нейронн(?:ая|ые|ой|ую) сет",
    "генеративн(?:ый|ого|ому|ым|ом) ии",
    "машинн(?:ое|ого|ому|ым|ом) обучен",
    "больш(?:ая|ой|ую|ие|их) языков(?:ая|ой|ую|ые|ых) модел",
    "вайб-?кодинг",
    "@artificial intelligence@",
    "@generative ai@",
    "@machine learning@",
    "@deep learning@",
    "@large language models?@",
    "@llms?@",
    "@ml@",
    "@vibe coding@",
    "@chatgpt@",
    "@openai@",
    "@anthropic@",
    r"@claude (?:ai|[0-9]|model)@",
    r"(?:модель|model)\s+claude@",
    "@google gemini@",
    r"(?:модель|model)\s+gemini@",
    r"@gemini (?:ai|[0-9])@",
    "@gpt-?[0-9]",
    "@(?:qwen|llama|deepseek|mistral|gemma|grok)(?:[0-9]|@)",
    "@copilot@",
    "@midjourney@",
    "@stable diffusion@",
    "@ai[- ]agents?@",
]

HEALTH = [
    "@health@", "@medicine@", "здоров", "медиц", "врач", "пациент", "больниц", "клиник", "аптек", "лекарств", "препарат",
    "вакцин", "диабет", "ожирен", "онколог", "инфекц", "грипп", "коронавирус", "covid", "фарма", "психолог", "психиатр",
    "депресс", "стресс", "инсульт", "инфаркт", "бессонниц", "симптом", "заболеван",
]

SECURITY_STRONG = [
    "кибер(?:атак|преступ|безопасност|угроз|шпион|мошенн|инцидент|войн|развед|полиц|расслед|защит)",
    "хакер", "уязвимост", "вредонос", "малвар", "шифровальщик", "фишинг", "эксплойт", "ботнет", "троян", "бэкдор", "руткит",
    "антивирус", "пентест", "инфобез", "даркнет", "информационн(?:ая|ой|ую) безопасност",
    "утечк[а-я]* (?:данных|персональн|баз|информац|парол)",
    "@ddos@", "@malware@", "@ransomware@", "@spyware@", "@rootkit@", "@phishing@", "@cve-[0-9]{4}-[0-9]+", "@zero-day@", "@0-day@",
    "@infostealer", "@data breach", "@cyber ?(?:attack|security|crime|threat|espionage)", "@hackers?@(?! news)", "@hacked@",
    "@botnet@", "@backdoor@", "@web shell@", "@dark ?web@", "@credential (?:theft|stuffing)", "@infosec@",
]
SECURITY_WEAK = ["взлом", "вымогател", "@exploit", "@vulnerabilit", "@breach"]
DIGITAL_CONTEXT = [
    "аккаунт", "учетн(?:ая|ой|ую) запис", "сайт", "сервер", "систем", "баз[а-я]* данных", "данны[ех]", "парол", "телефон",
    "смартфон", "компьютер", "ноутбук", "сет[ьи]@", "почт", "приложен", "мессендж", "крипто", "бирж", "банк", "@по@", "софт",
    "программ", "прошивк", "плагин", "патч", "обновлен", "устройств", "роутер", "камер", "браузер", "@ит@", "@it@", "windows",
    "linux", "android", "ios", "iphone", "chrome", "api", "wi-?fi", "bluetooth", "@software@", "@servers?@", "@network",
    "@password", "@accounts?@", "@devices?@", "@apps?@", "@router", "@database", "@credential", "@patch", "@update", "@browser",
    "@plugin", "@firmware", "@cloud@", "@email@", "@crypto",
]

RU = r"\p{L}*"

MARKETS_STRONG = [
    "мосбирж", "моск(?:овской|овская|овскую) бирж", "ммвб", f"индекс{RU} ртс",
    f"фондов{RU} (?:рынок|рынк{RU}|бирж{RU}|индекс{RU})", "биржев", "котировк", "дивиденд", "облигаци", "делистинг", "листинг",
    "акционер(?!н)", "трейдер", "брокер", "фьючерс", "опцион(?!альн)", "эмитент", f"депозитарн{RU} расписк",
    "ценны(?:е|х|ми) бумаг", f"(?:обыкновенн|привилегированн){RU} акци", "капитализаци", "офз~", f"обратн{RU} выкуп акци",
    "уолл-стрит(?! ?джорнал)", "индекс (?:мосбирж|доу|насдак|s&p)", r"imoex\p{N}*~", "ipo~", "spo~", "etf~", "nasdaq~", "nyse~",
    "ftse~", "stoxx~", "nikkei~", "buyback~", "s&p ?500~", "dow jones~", "hang seng~", "share price~", "shareholders?~",
    "stock (?:market|exchange)~", "wall street~(?! journal)",
]
MARKETS_WEAK = [
    "акци(?:я|и|й|ю|ям|ями|ях)~", "торг(?:и|ах|ов|ами)~", "бирж", "инвестор",
    f"рынок (?:акци{RU}|облигац{RU}|капитал{RU}|ценных бумаг)",
]
MARKETS_CONTEXT = [
    "бирж", "котиров", "акционер(?!н)", "дивиденд", "трейдер", "брокер", "эмитент", "капитализац", "облигац", "фьючерс", "офз~",
    "подорожал", "подешевел", "вырос", "рост(?!ов)", "снижени", "падени", "снизил", "упал", "пункт", "процент",
    f"торгов{RU} сесси", "ценны(?:е|х|ми) бумаг",
]
MARKETS_EXCLUDE = [
    "акци(?:я|и|ю|ей) (?:протеста|неповиновения|памяти|солидарности|устрашения|возмездия)",
    f"(?:протестн|благотворительн|рекламн|террористическ|гуманитарн|экологическ){RU} акци",
    f"индекс (?:массы тела|потребительских цен|цен производителей|промышленн{RU}|производств{RU}|деловой активности|человеческого развития|счастья|бедности|качества жизни)",
    "протест", "митинг", "демонстрац", "пикет", "забастовк", "госзакупк", "торги по (?:закупк|аренде)",
    "аукцион по продаже (?:имущества|земл)",
]

IBS_NAME = "(?:ibs|ибс)~"
IBS_STRONG = [
    rf"(?:гк|группа компаний|групп{RU}|компани{RU}|холдинг{RU}|интегратор{RU})\s+«?{IBS_NAME}",
    rf"{IBS_NAME}\s+(?:group|груп|холдинг|россия|экспертиза|софт)",
    r"ibs\.ru",
]
IBS_WEAK = [IBS_NAME]
IBS_CONTEXT = [
    "ит-", "ит~", "айти", "интегратор", "аутсорсинг", "консалтинг", "импортозамещ", "цифровизац", "цифров", f"разработ{RU}",
    "программн", "софт", "систем", "сервис", "заказчик", "внедрен", "подрядчик", "выручк", "прибыл", "ipo~", "сотрудник", "инженер",
    "software", "integrator", "outsourcing", "consulting",
]
IBS_EXCLUDE = [
    "ишемическ", "кардиолог", "стенокард", f"болезн{RU} сердца", "инфаркт", "кишечник", "гастроэнтеролог", "ischemic",
    "ischaemic", "irritable bowel", "bowel", "cardiac", "heart disease",
]


def spelled(term: str) -> str:
    """A term for Java's engine; the inner side of an ASCII edge is known, so one look outside decides it."""
    from tidewire.functions.text import RIGHT_EDGE, SPACE

    out = []
    for i, c in enumerate(term):
        if c != "@":
            out.append(c)
            continue
        inner = next((x for x in (term[i + 1 :] if i == 0 else term[i - 1 :: -1]) if x.isalnum()), "")
        look = ("!" if inner.isascii() else "=") + "[a-z0-9_])"
        out.append(("(?<" if i == 0 else "(?") + look)
    return "".join(out).replace("~", RIGHT_EDGE).replace(r"\s", f"[{SPACE}]")


def first_letters(term: str) -> str | None:
    """Characters that a match can begin with; None if that is not plain from the term's start."""
    bare = term.lstrip("@")
    if bare[0].isalnum() or bare[0] == "«":
        return bare[0]
    m = re.match(r"\(\?:([^()]+)\)", bare)
    heads = [x[:1] for x in m[1].split("|")] if m else []
    return "".join(heads) if heads and all(h.isalnum() for h in heads) else None


def alternation(terms: list[str]) -> str:
    """Terms with one first letter share it, so that a place in a text is tried against letters, not terms."""
    heads: dict[str, list[str]] = {}
    for t in terms:
        bare = t.removeprefix("@")
        out = spelled(t).removeprefix("(?<![a-z0-9_])") if t != bare else spelled(t)
        single = out[0].isalnum()
        heads.setdefault(out[0] if single else "", []).append(out[1:] if single else out)
    return "|".join("|".join(rest) if not h else h + (f"(?:{'|'.join(rest)})" if len(rest) > 1 else rest[0]) for h, rest in heads.items())


def one_of(letters: str) -> str:
    """A look ahead for one of some characters, neighbours as ranges: the engine tests a class piece by piece."""
    out: list[str] = []
    for c in sorted(set(letters)):
        if out and ord(c) == ord(out[-1][-1]) + 1:
            out[-1] = out[-1][0] + c
        else:
            out.append(c)
    return f"(?=[{''.join('-'.join(r) for r in out)}])"


def java(terms: list[str], anchored: bool = False) -> str:
    """One alternation for Java's engine, for lower-cased text."""
    from tidewire.functions.text import LEFT_EDGE

    worded = [t for t in terms if t[0] == "@" and next(x for x in t[1:] if x.isalnum()).isascii()]
    free = [t for t in terms if t not in worded]
    parts = ([alternation(free)] if free else []) + ([f"(?<![a-z0-9_])(?:{alternation(worded)})"] if worded else [])
    letters = [first_letters(t) for t in terms]
    ahead = "" if None in letters else one_of("".join(letters))
    return ahead + (LEFT_EDGE if anchored else "") + f"(?:{'|'.join(parts)})"


def any_term(free: list[str], anchored: list[str] = ()) -> str:
    """What every text with one of these terms matches: one pass that spares most texts a pass for each rule.

    Latin terms that begin words are tried where no Latin letter stands before them, all others everywhere.
    """
    latin = [t for t in (*free, *anchored) if first_letters(t)[0].isascii()]
    other = [t for t in (*free, *anchored) if t not in latin]
    starting = [t for t in latin if t[0] == "@" or t in anchored]
    parts = (("", other), ("", [t for t in latin if t not in starting]), ("(?<![a-z])", starting))
    return "|".join(f"{edge}{one_of(''.join(map(first_letters, ts)))}(?:{alternation(ts)})" for edge, ts in parts if ts)
