"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, k=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard_components(docs, num=80):
    """docs: {id: text} -> {id: (n_shingles, component)}"""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed_words(docs, window=20):
    """docs: {id: text} -> {id: kept words}"""
    first, all_words = {}, {i: words(t) for i, t in docs.items()}
    for i in sorted(docs):
        w = all_words[i]
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    kept = {}
    for i, w in all_words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept[i] = [x for p, x in enumerate(w) if p not in gone]
    return kept


def statistics(text):
    text = text or ""
    w = words(text)
    triples = defaultdict(list)
    for i in range(len(w) - 2):
        triples[tuple(w[i : i + 3])].append(i)
    covered = {p for at in triples.values() if len(at) > 1 for i in at for p in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    rank = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def der_parts(data, at, end):
    """(tag, content start, content end) of the elements that fill data[at:end]; None if they do not nest."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 128:
            n = size - 128
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 128 or data[at - n] == 0:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_ed25519_key(data):
    """PKCS#8 version, the algorithm's identifier, octets; nothing after them."""
    top = der_parts(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_parts(data, *top[0][1:])
    if not parts or [p[0] for p in parts[:3]] != [2, 0x30, 4]:
        return False
    inner = der_parts(data, *parts[1][1:])
    return bool(inner) and inner[0][0] == 6 and data[inner[0][1] : inner[0][2]] == bytes.fromhex("2b6570")


def keys_in(text):
    """Places of all Ed25519 keys that some substring decodes to: whole quartets or an unpadded rest, either alphabet."""
    import base64

    out = set()
    plain = text.replace("-", "+").replace("_", "/")
    for a in range(len(plain)):
        for b in range(a + 32, len(plain) + 1):
            part = plain[a:b]
            if re.search(r"[^A-Za-z0-9+/]", part):
                break
            if len(part) % 4 != 1 and is_ed25519_key(base64.b64decode(part + "=" * (-len(part) % 4))):
                out.add((a, b))
    return out


# --- toxicity -------------------------------------------------------------------------------

ENDS = " \t\n\r\x0b\x0c.,;:!?…\"'`´“”„«»‹›‘’()[]{}<>|#$%&*_-–—/\\=+~^"


def best_entry(word, entries):
    """(edits, number) of an entry: a stem that begins the word, or the whole word of fewest edits; None without any."""
    found = []
    for i, e in enumerate(entries):
        if e.stem:
            if word.startswith(e.term):
                found.append((0, 1, i))
        elif abs(len(word) - len(e.term)) <= e.edits and (d := distance(word, e.term)) <= e.edits:
            found.append((d, 0, i))
    best = min(found, default=None)
    return best and (best[0], best[2])


def hit_of(word, entries):
    """The word's entry, or that of the word with look-alikes read as letters, which is worth an edit."""
    if len(word) < 3:
        return None
    hit = best_entry(word, entries)
    plain = word
    for a, b in zip("013457@$", "oieastas", strict=True):
        plain = plain.replace(a, b)
    if (hit is None or hit[0]) and plain != word:
        other = best_entry(plain, entries)
        if other and (hit is None or other[0] + 1 < hit[0]):
            hit = (max(1, other[0]), other[1])
    return hit


def hits_in(token, entries):
    """Hits of the words that punctuation parts a token into, else of the token itself, ends stripped."""
    whole = token.strip(ENDS)
    letters = lambda c: c.isalnum() or c in "@$" or unicodedata.category(c).startswith("M")
    runs = "".join(c if letters(c) else "\n" for c in whole).split()
    inner = [r.strip(ENDS) for r in runs] if len(runs) > 1 else []
    found = [h for r in inner if len(r) >= 3 and (h := hit_of(r, entries))]
    return found or [h for h in [hit_of(whole, entries)] if h]


def around(tokens, at):
    """1, less inside quotation marks (less still where someone says something), more where someone is addressed."""
    from tidewire.llm.toxicity import ADDRESS, REPORTING

    opening, closing = "\"“„«‹‘", "\"”“»›’"
    left, right = tokens[max(0, at - 10) : at + 1], tokens[at : at + 11]
    quoted = False
    for k, t in enumerate(reversed(left)):
        if t[0] in opening or (k and t[-1] in closing):
            quoted = t[0] in opening
            break
    quoted = quoted and any(t[-1] in closing or (t.rstrip(".,;:!?") or " ")[-1] in closing for t in right)
    near = {t.strip(ENDS) for t in [*left, *right]}
    if quoted:
        return 0.15 if near & REPORTING else 0.3
    return 1.5 if near & ADDRESS else 1.0


def toxic_features(text, entries):
    """What the forest sees of a text, hit by hit and window by window."""
    tokens = (text or "").lower().split()
    hits = [(i, edits, entries[e], e, around(tokens, i)) for i, t in enumerate(tokens) for edits, e in hits_in(t, entries)]
    exact = [h for h in hits if not h[1]]
    weight = lambda h: h[2].weight / (1 + 2 * h[1])
    # A window ends at a hit and begins 20 words before it.
    windows = [sum(weight(o) * o[4] for k, o in enumerate(hits[: n + 1]) if o[0] >= h[0] - 20) for n, h in enumerate(hits)]
    total = sum(map(weight, hits))
    drift = sum(e.toxic_rate - e.clean_rate for e in entries)
    return [
        math.log1p(len(tokens)),
        sum(h[2].weight for h in exact) - len(tokens) * drift,
        sum(h[2].weight for h in exact),
        max(windows, default=0.0),
        100 * len(hits) / max(len(tokens), 20),
        len({h[3] for h in exact}),
        sum(h[2].weight / (1 + h[1]) * h[4] for h in hits if h[1]),
        sum(weight(h) for h in hits if h[4] < 1) / total if total else 0.0,
    ]
