"""Secret scans with structural confirmation.

Base patterns report spans by shape alone. The structural method adds spans: base64 and hex
candidates are decoded, and a span is reported only if the bytes parse as a key encoding
(nested DER lengths, length-prefixed OpenSSH fields) or as a signed-token header.

A key may begin anywhere in a run of base64 of either alphabet, or of hex digits; runs go on over line ends,
real or escaped, and indentation, hex runs also over what is written between bytes (colons, spaces, 0x). The
lengths inside a key say where it ends. The header of a signed token is whatever decodes to a JSON object with an
algorithm, white space and all, and may follow other characters of its alphabet.

Defined results: a null text is empty and has no spans; very long texts are read whole, in time in
proportion to their length; a null id is passed on; repeated rows give repeated results; spans that
start together come by kind; an empty table gives no rows. find_secrets reads its two columns only,
and mask returns every column, whatever their names. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_batches

#: Base kinds in their fixed order, with the least length of what must be long enough.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "signed_token")

#: Where a key may begin in base64 of either alphabet: a DER sequence, an OpenSSH blob or container; 16 characters in one line.
KEY_START = re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{14})|A(?=AAA[BCE][A-Za-z0-9+/_-]{11})|b(?=3BlbnNzaC1rZXkt)")
#: Lines of a run; they end with a line end, real or escaped, and may be indented.
RUN_LINE = re.compile(r"([A-Za-z0-9+/_-]++)((?:\r?\n|\\r\\n|\\n)[ \t]*+(?=[A-Za-z0-9+/_-]))?")
STANDARD = str.maketrans("-_", "+/")
#: A sequence whose first element is a number or a sequence.
DER_HEAD = re.compile(rb"\x30(?:[\0-\x7f]|\x81.|\x82..|\x83...|\x84....)[\x02\x30]", re.S)
#: What may stand between the digits of a hex run, runs that can hold a key, and where in their digits one may begin:
#: a DER sequence of a number or a sequence, an OpenSSH blob (its length and "ssh-" or "ecdsa") or container.
HEX_BREAK = r"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*(?:0x)?|,[ \t]*0x|[ :-](?:0x)?|\\x)"
HEX_RUN = re.compile(rf"(?:[0-9A-Fa-f](?:{HEX_BREAK}(?=[0-9A-Fa-f]))?+){{48,}}+")
HEX_PIECE = re.compile(rf"([0-9A-Fa-f]++)({HEX_BREAK}(?=[0-9A-Fa-f]))?+")
HEX_START = re.compile(r"(?=30(?:[0-7].|81..|82....|83......|84........)(?:02|30)|000000(?:077373682d|0b7373682d|136563647361)|6f70656e7373682d6b65792d7631)")
#: A signed token: a run that can be a header, with what follows it; any such run may be one, so they may overlap.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,}+)(?=\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))")
BLANKS = b" \t\r\n"
BRACE = re.compile(r"\{|\"(?:[^\"\\]|\\.)*+\"?", re.S)
JSON = json.JSONDecoder()
#: Object identifiers (DER content bytes) of key algorithms: RSA, EC, Ed25519, X25519, DSA.
KEY_OIDS = (
    bytes.fromhex("2a864886f70d010101"),
    bytes.fromhex("2a8648ce3d0201"),
    bytes.fromhex("2b6570"),
    bytes.fromhex("2b656e"),
    bytes.fromhex("2a8648ce380401"),
)
#: Key types of OpenSSH blobs and their number of fields, the type among them.
SSH_TYPES = {
    b"ssh-rsa": 3,
    b"ssh-dss": 5,
    b"ssh-ed25519": 2,
    b"ecdsa-sha2-nistp256": 3,
    b"ecdsa-sha2-nistp384": 3,
    b"ecdsa-sha2-nistp521": 3,
}
SSH_MAGIC = b"openssh-key-v1\0"
#: Elements that the longest known key encoding has.
MOST_PARTS = 9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The three base kinds, leftmost and non-overlapping within a kind; too short matches drop out."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_VALUE:
            out.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                out.append(("access", m.start(), m.end()))
    for m in HEX.finditer(text):
        out.append(("hex", m.start(), m.end()))
    return out


#: read(at, n): n bytes of a candidate from a place, fewer where it ends. Only headers are read, so that
#: a candidate costs the same whatever length it claims.
Read = Callable[[int, int], bytes]


def der_element(read: Read, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at a place; None if lengths don't nest."""
    head = read(at, 6)
    if len(head) < 2:
        return None
    tag, size, at = head[0], head[1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        size = int.from_bytes(head[2 : 2 + n], "big")
        if not 1 <= n <= 4 or size < 0x80 or head[2] == 0:  # not the shortest form: not DER
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def der_children(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a content exactly; none if they are more than any key has."""
    out = []
    while at < end:
        e = der_element(read, at, end)
        if e is None or len(out) == MOST_PARTS:
            return None
        out.append(e)
        at = e[2]
    return out


def der_key_size(read: Read, most: int) -> int:
    """Size of the private or public key that starts here (PKCS#1, PKCS#8, SEC1, SubjectPublicKeyInfo), else 0."""
    top = der_element(read, 0, most)
    if not top or top[0] != 0x30:
        return 0
    parts = der_children(read, top[1], top[2])
    if not parts:
        return 0
    tags, size = [p[0] for p in parts], top[2]
    content = lambda p: read(p[1], p[2] - p[1])
    algorithm = next((p for p in parts[:2] if p[0] == 0x30), None)
    if algorithm:  # PKCS#8 (version, algorithm, octets) or a public key (algorithm, bits)
        inner = der_children(read, algorithm[1], algorithm[2])
        known = bool(inner) and inner[0][0] == 0x06 and inner[0][2] - inner[0][1] < 16 and content(inner[0]) in KEY_OIDS
        return size if known and (tags[:3] == [0x02, 0x30, 0x04] or tags == [0x30, 0x03]) else 0
    if tags[:2] == [0x02, 0x04]:  # SEC1: version 1, octets, optional tagged parameters
        return size if parts[0][2] - parts[0][1] == 1 and content(parts[0]) == b"\1" and parts[1][2] - parts[1][1] >= 20 else 0
    # PKCS#1: version 0 and eight integers, or modulus and exponent, or DSA's six.
    return size if set(tags) == {0x02} and len(tags) in (2, 6, 9) and max(p[2] - p[1] for p in parts) >= 48 else 0


def ssh_key_size(read: Read, most: int) -> int:
    """Size of the OpenSSH public key blob or private key container that starts here, else 0."""
    if read(0, len(SSH_MAGIC)) == SSH_MAGIC:  # cipher, kdf, kdf options, one key: its public and its private part
        at, fields = len(SSH_MAGIC), 5
    else:
        name = read(4, int.from_bytes(read(0, 4), "big")) if read(0, 3) == b"\0\0\0" else b""
        at, fields = 0, SSH_TYPES.get(name, 0)
    container = at > 0
    for i in range(fields):
        if container and i == 3:
            if read(at, 4) != b"\0\0\0\1":
                return 0
            at += 4
        size = read(at, 4)
        if len(size) < 4:
            return 0
        at += 4 + int.from_bytes(size, "big")
        if at > most:
            return 0
    return at if fields else 0


def key_at(read: Read, most: int) -> tuple[str, int] | None:
    """(kind, size) of the key that starts here."""
    if size := der_key_size(read, most):
        return ("der_key", size) if size >= 24 else None
    size = ssh_key_size(read, most)
    return ("ssh_key", size) if size else None


class Run:
    """A run of a text from a place on: its characters without what parts its pieces, and where each stands."""

    def __init__(self, text: str, start: int, piece: re.Pattern):
        self.starts, self.sums, bodies = [], [0], []
        at: int | None = start
        while at is not None and (m := piece.match(text, at)):
            self.starts.append(at)
            bodies.append(m[1])
            self.sums.append(self.sums[-1] + len(m[1]))
            at = m.end() if m[2] else None
        self.body = "".join(bodies)
        self.end = self.starts[-1] + len(bodies[-1])

    def index(self, place: int) -> int:
        line = bisect_right(self.starts, place) - 1
        return self.sums[line] + place - self.starts[line]

    def place(self, index: int) -> int:
        """Place of the index-th character."""
        line = bisect_right(self.sums, index) - 1
        return self.starts[line] + index - self.sums[line]

    def base64_from(self, first: int) -> Read:
        def read(at: int, n: int) -> bytes:
            a = first + at // 3 * 4
            b = first + (at + n + 2) // 3 * 4
            quartets = self.body[a:b].translate(STANDARD)
            quartets = quartets[: len(quartets) - 1] if len(quartets) % 4 == 1 else quartets
            return base64.b64decode(quartets + "=" * (-len(quartets) % 4))[at % 3 : at % 3 + n]

        return read

    def hex_from(self, first: int) -> Read:
        def read(at: int, n: int) -> bytes:
            digits = self.body[first + 2 * at : first + 2 * (at + n)]
            return bytes.fromhex(digits[: len(digits) & ~1])

        return read


def key_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64, at any place of a run: the lengths inside say where a key ends, its padding is part of it."""
    out: list[tuple[str, int, int]] = []
    run, done = None, 0
    for m in KEY_START.finditer(text):
        at = m.start()
        if at < done:
            continue
        if run is None or at >= run.end:
            # The first bytes tell most candidates from keys before their run is gathered.
            if m[0] == "M" and not DER_HEAD.match(base64.b64decode(text[at : at + 16].translate(STANDARD))):
                continue
            run = Run(text, at, RUN_LINE)
        first = run.index(at)
        found = key_at(run.base64_from(first), (len(run.body) - first) * 3 // 4)
        if found:
            end = run.place(first + (found[1] * 4 + 2) // 3 - 1) + 1
            pad = -found[1] % 3
            done = end + pad * (text[end : end + pad] == "=" * pad)
            out.append((found[0], at, done))
    return out


def hex_key_spans(text: str) -> list[tuple[str, int, int]]:
    """Keys in hex digits, at any place of a run."""
    out: list[tuple[str, int, int]] = []
    for m in HEX_RUN.finditer(text):
        run, done = Run(text, m.start(), HEX_PIECE), 0
        for s in HEX_START.finditer(run.body.lower()):
            first = s.start()
            if first >= done and (found := key_at(run.hex_from(first), (len(run.body) - first) // 2)):
                done = first + 2 * found[1]
                out.append((found[0], run.place(first), run.place(done - 1) + 1))
    return out


def urlsafe(run: str) -> bytes | None:
    if len(run) % 4 == 1:
        return None
    return base64.urlsafe_b64decode(run + "=" * (-len(run) % 4))


def is_object(data: bytes | None) -> bool:
    try:
        return data is not None and isinstance(json.loads(data.decode()), dict)
    except (ValueError, RecursionError):
        return False


def objects(text: str) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of the JSON objects in a text, but those inside of others, in linear time.

    Where reading fails, what it took for the start of an object in an object fails at the same place; only
    braces in what it took for strings are tried again. Objects nested beyond the parser's depth are none.
    """
    no: set[int] = set()
    at = text.find("{")
    while at >= 0:
        if at not in no:
            try:
                value, stop = JSON.raw_decode(text, at)
                yield at, stop, value
            except json.JSONDecodeError as e:
                stop = e.pos
            except RecursionError:
                stop = len(text)
            no.update(m.start() for m in BRACE.finditer(text, at + 1, stop) if m[0] == "{")
        at = text.find("{", at + 1)


def header_start(run: str, signed: bool) -> int:
    """Where in a run the header of a signed token begins that ends with it; -1 if there is none.

    Each of the four ways to begin a quartet decodes the run once. An object in it that ends with the run and names an
    algorithm is a header, together with the white space before it.
    """
    found = []
    for skip in range(4):
        data = urlsafe(run[skip:])
        tail = data.rstrip(BLANKS) if data else b""
        if not tail.endswith(b"}") or b'"alg"' not in tail:
            continue
        for at, end, header in objects(tail.decode("latin-1")):
            alg = header.get("alg")
            blank = at
            while blank and tail[blank - 1] in BLANKS:
                blank -= 1
            start = -(-blank // 3) * 3  # a header begins with a quartet, and has only white space before its object
            if end == len(tail) and isinstance(alg, str) and (signed or alg.lower() == "none") and start <= at and is_object(tail[at:]):
                found.append(skip + start // 3 * 4)
    return min(found, default=-1)




def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens: a JSON header that names an algorithm, a JSON object, a signature (empty only for none)."""
    out = []
    for m in SIGNED.finditer(text):
        if m[2] and is_object(urlsafe(m[2])) and (at := header_start(m[1], bool(m[3]))) >= 0:
            out.append(("signed_token", m.start() + at, m.end(3)))
    return out


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that decode and parse; everything else is left to the base patterns."""
    return key_spans(text) + hex_key_spans(text) + token_spans(text)


_RANK = {k: i for i, k in enumerate(KINDS)}


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None) -> tuple[list, list]:
    """(base spans, all spans), each by start, then kind."""
    if not text:
        return [], []
    base = in_order(base_spans(text))
    more = structural_spans(text)
    return base, (in_order(base + more) if more else base)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for text in batch.column(1).to_pylist():
            base, spans = scan(text)
            for i in range(3):
                cols[i].append(sum(s[0] == KINDS[i] for s in base))
            cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[4].append(joined(spans))
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = map_batches(
        docs.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as string) as body"),
        run,
        f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
    return out.withColumnRenamed("id", id_col)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every reported span replaced; of overlapping spans the union goes."""
    _, spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """All rows and columns; texts with their secrets replaced, the size column (if there is one) to match. No shuffle."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        clean = [redact(t, mark) for t in texts]
        return batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = map_batches(docs, run, schema)
    if size_col not in docs.columns or size_col == text_col:
        return out
    kind = docs.schema[size_col].dataType
    changed = F.col(text_col).contains(mark)
    return out.withColumn(size_col, F.when(changed, F.length(text_col).cast(kind)).otherwise(F.col(size_col)))
