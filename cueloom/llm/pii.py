"""Personal data: candidate spans from wide generators, judged by boosted trees, with calibrated thresholds.

The four base kinds (email, ip, card, phone) follow fixed patterns and are always kept. Beside them, generators propose spans
that those patterns miss: phones and cards that run into the next number (the base patterns take both as one, and drop it),
emails spelt out, phones without a plus, other groupings, IPv6, national ids, account numbers, keys and passwords. Each
candidate gets features of its format and of the words around it; gradient-boosted trees, trained here on synthetic sentences
with look-alikes (dates, versions, order numbers, prices, measures, checksums), give a score, isotonic calibration by kind turns it
into a probability, and each kind has the threshold that gave ``PRECISION`` on sentences held out for it. Those that reach it
are added unless they overlap a base span or a better candidate.

Offsets are code points, ends exclusive. A null or empty text has no spans. Every row gives a row, repeated rows too. Matching takes time
in proportion to the text: patterns use possessive or bounded repeats or start from a fixed character, and overlaps are found by
binary search.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import boosting, common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "account", "secret")
PRECISION = 0.95
#: Examples of each sort in the synthetic training set; the model's size doesn't depend on the corpus.
EXAMPLES = 220

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ backwards to the one before at most, and forwards; so each character is looked at a few times."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = low + len(text[low:at].rstrip(_LOCAL))
        low = at + 1
        if begin < at and (m := _DOMAIN.match(text, low)):
            yield begin, m.end()
            low = m.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


#: An email spelt out, from its "at" on; the local part is then looked for before it.
_SPELT = re.compile(r"(?:\x20?[(\[{]\x20?(?:at|AT)\x20?[)\]}]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z]{2,24}){1,4}(?![A-Za-z])")
_SPELT_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63}\Z")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_DIGIT = re.compile("[0-9]")
_LAST_GROUPS = re.compile(r"[\x20./-]++(?=[0-9])")
#: Wide on purpose; what they propose is judged afterwards.
GENERATORS = (
    ("card", re.compile(r"(?<![0-9.-])[0-9]{4}[\x20.\-/][0-9]{4,6}[\x20.\-/][0-9]{4,5}(?:[\x20.\-/][0-9]{3,4})?(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])|\+[0-9]{9,15}(?![0-9])|(?<![0-9.+-])(?:00[0-9]{1,3}[\x20.-]?|[01][\x20.-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,2}(?![0-9-])|(?<![0-9])[0-9]{10}(?![0-9])")),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])|(?<![0-9A-Za-z])[A-Z]{1,2}[\x20]?[0-9]{6,8}[A-Z]?(?![0-9A-Za-z])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,127}[0-9])[A-Za-z0-9+/_-]{16,128}+={0,2}(?![A-Za-z0-9+/_=-])")),
)
#: Passwords in an assignment (the value is the span) and private keys, which need hold no digit.
_ASSIGNED = re.compile(r"(?i:pass(?:word|wd|wort|phrase)|pwd|contrase\u00f1a|secret|api[_-]?key|token)\x20?[:=]\x20?[\"']?([^\s\"',;]{6,64})(?![^\s\"',;])")
_PRIVATE = re.compile(r"-----BEGIN[A-Z\x20]{0,40}PRIVATE\x20KEY-----[A-Za-z0-9+/=\s]*+-----END[A-Z\x20]{0,40}PRIVATE\x20KEY-----")
CUES = {
    "email": re.compile(r"e-?mail|contact|write|reach|courriel|correo|adresse|address", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta|charge", re.I),
    "phone": re.compile(r"call|phone|\btel\b|mobile|fax|dial|whatsapp|sms|handy|telefon|t[eé]l[eé]phone|tel[eé]fono|m[oó]vil", re.I),
    "id": re.compile(r"ssn|social|passport|licen[cs]e|national|identity|\bid\b|ausweis|passeport|pasaporte|\bdni\b", re.I),
    "account": re.compile(r"iban|account|bank|transfer|konto|compte|cuenta", re.I),
    "secret": re.compile(r"token|secret|api.?key|access.?key|passw|pwd|passphrase|auth|bearer|credential|private|contrase", re.I),
}
AGAINST = re.compile(r"order|invoice|version|isbn|issn|build|ticket|serial|page|chapter|since|date|\bno\.|number of|total|price|usd|eur|model|part|release|tracking|sku|ratio|score|lines?|rows?|commit|sha-?[0-9]|md5|checksum|digest|revision|uuid|request", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)?[0-9]{2}")
_YEARS = re.compile(r"(?:19|20)[0-9]{2}[-\x20](?:19|20)[0-9]{2}")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = _NOT_DIGIT.sub("", s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    low = s.lower()
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        len(groups),
        max(groups, default=0),
        groups[-1] if groups else 0,
        groups[0] if groups else 0,
        sum(c in " .-/()" for c in s),
        s.count("."),
        s.count("-"),
        "(" in s or "[" in s,
        s.startswith("00"),
        s.startswith("+"),
        bool(digits) and 12 <= len(digits) <= 19 and luhn(digits),
        kind == "account" and _iban_ok(s),
        len(set(digits)),
        bool(_DATE.fullmatch(s) or _YEARS.search(s)),
        bool(CUES[kind].search(left)),
        bool(AGAINST.search(left)),
        left[-1:].isalnum() or bool(left) and left[-1] in "_=/#$€",
        right[:1].isalnum() or bool(right) and right[0] in "_=/%€$",
        bool(re.match(r"\x20?(?:%|kg|km|m\b|eur|usd|€|\$|px|mb|gb)", right, re.I)),
        s.count(":"),
        "dot" in low or "." in low,
        bool(re.search(r"\bat\b|@", low)),
        bool(re.search(r"(?:\.|dot[)\]}]?\x20?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us)\Z", low)),
        *([_entropy(s[:128]), s.count("/"), any(c.isupper() for c in s), any(c.islower() for c in s), bool(re.fullmatch("[0-9a-fA-F]+", s)), bool(re.match(r"(?:AKIA|ASIA|gh[opsu]_|sk-|xox[abp]-|AIza|-----BEGIN)", s)), bool(re.search(r"[=:]\x20?[\"']?\Z", left))] if kind == "secret" else [0] * 7),
    ]


_SYLLABLES = "an en in on er th re st nd ti es or ch ou le la de un ge be au ie que tion ver los cas men".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def _with_check(d: str) -> str:
    return next(d + c for c in "0123456789" if luhn(d + c))


def synthetic(seed: int = 20, examples: int = EXAMPLES) -> list[tuple[str, int, int, str]]:
    """(text, start, end, kind): an item in the middle of an invented sentence; kind is empty where it is none of ours. Other items may stand close by."""
    r = random.Random(seed)
    tld = lambda: r.choice("com org net de fr es info".split())
    sep = lambda: r.choice([" ", "-", "."])

    def mail() -> str:
        at, dot = r.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" @ ", "."), ("(at)", ".")])
        local = _word(r) + r.choice(["", "", f"{r.choice('._')}{_word(r)}", str(r.randint(1, 99)), f".{r.randint(1, 99)}"])
        return f"{local}{at}{_word(r)}{dot}{tld()}"

    def phone() -> str:
        p = sep()
        return r.choice(
            [
                lambda: f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}",
                lambda: f"{_digits(r, 3)}{p}{_digits(r, 3)}{p}{_digits(r, 4)}",
                lambda: f"00{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 4)}",
                lambda: f"0{_digits(r, 1)}{p}{p.join(_digits(r, 2) for _ in range(4))}",
                lambda: f"1{p}{_digits(r, 3)}{p}{_digits(r, 3)}{p}{_digits(r, 4)}",
                lambda: f"+{r.randint(1, 99)} ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}",
                lambda: f"+{r.randint(1, 99)}{p}{_digits(r, 3)}{p}{_digits(r, 3)}{p}{_digits(r, 4)}",
            ]
        )()

    def card() -> str:
        d = _with_check(r.choice("3456") + _digits(r, 14))
        p = r.choice([".", "/", " ", "-", "", ""])
        return p.join(d[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        c, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), _digits(r, r.choice([16, 18, 20]))
        n = 98 - int(body + "".join(str(int(x, 36)) for x in c) + "00") % 97
        s = f"{c}{n:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    text_of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))

    def secret() -> str:
        letters = r.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-"])
        return text_of(letters, r.choice([20, 24, 32, 36, 40, 40, 64])) + str(r.randint(0, 9))

    yes = [
        ("email", mail, ["email", "contact", "write to", ""]),
        ("phone", phone, ["call", "phone", "tel", "mobile", "telefon", "", ""]),
        ("card", card, ["card", "visa", "payment", ""]),
        ("ip", lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8)), ["ip", "host", "server", ""]),
        ("id", lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{_digits(r, 4)}", ["ssn", "social security", "id", ""]),
        ("id", lambda: f"{r.choice('ABCXK')}{_digits(r, 8)}", ["passport", "passport no", "identity", "ausweis"]),
        ("account", iban, ["iban", "account", "bank", ""]),
        ("secret", secret, [f"{name}{eq}" for name in ("token", "api_key", "secret", "access key", "auth token", "API-KEY", "client_secret", "bearer") for eq in (" =", ":", "=", "", ' = "', ': "')]),
        ("secret", secret, ["password =", "password:", 'passwd = "', "pwd=", "Passwort:", "private key"]),
        ("secret", lambda: r.choice(["AKIA", "ghp_", "sk-", "xoxb-", "AIza"]) + text_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567abcdefghijklmnop", r.randint(16, 36)) + "7", ["", "key", "use"]),
        ("secret", lambda: text_of("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789!$", r.randint(8, 16)), ["password:", 'password = "', "pwd=", "passwd: ", "Passwort:", "passphrase:"]),
    ]
    no = [
        (lambda: f"{_word(r)} at {_word(r)}.{r.choice(['Then', 'The', 'And', 'But'])}", ["", ""]),
        (lambda: f"{r.randint(1990, 2029)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", ["since", "date", ""]),
        (lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1990, 2029)}", ["date", ""]),
        (lambda: f"{r.randint(1900, 2029)}-{r.randint(1900, 2029)} {r.randint(10, 99)}-{r.randint(10, 99)}", ["since", ""]),
        (lambda: _digits(r, 10), ["order", "invoice", "serial", "tracking", ""]),
        (lambda: _digits(r, r.randint(12, 19)), ["order", "serial", "tracking", "", ""]),
        (lambda: f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", ["total", "price", "lines", "rows", ""]),
        (lambda: f"{r.randint(10, 99)}.{r.randint(10, 99)}.{r.randint(10, 99)}", ["version", "release", ""]),
        (lambda: f"{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}", ["score", ""]),
        (lambda: f"978-{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", ["isbn", ""]),
        (lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", ["date", ""]),
        (lambda: f"{r.choice('ABCXK')}{_digits(r, 7)}", ["part", "model", "sku", "order", ""]),
        (lambda: f"{r.choice(['SN', 'PX', 'AB'])}{_digits(r, 2)}{_digits(r, 12)}", ["serial", "part", ""]),
        (lambda: f"{_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)}", ["total", "model", "score", ""]),
        (lambda: text_of("0123456789abcdef", r.choice([32, 40, 64])), ["commit", "sha1", "sha256:", "md5", "checksum:", "digest", "revision", "build"]),
        (lambda: text_of(r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]), r.choice([16, 20, 32, 40])) + "4", ["", "see", "of", "file"]),
        (lambda: "-".join(text_of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), ["request", "uuid", "uuid:", "id", ""]),
        (lambda: f"{_word(r)}-{_word(r)}_{_word(r)}-{_word(r)}-{_word(r)}{_digits(r, 2)}", ["see", "file", "", "part"]),
        (lambda: f"/{_word(r)}/{_word(r)}/{r.randint(1990, 2029)}/{_word(r)}-{_word(r)}-{_word(r)}", ["see", "at", "", "https://www"]),
        (lambda: r.choice(["required", "optional", "changed", "forgotten", "<hidden>", "********"]), ["password:", "token:", "passwd ="]),
    ]
    v4 = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    sorts = [*yes, *(("", make, cues) for make, cues in no)]
    out = []
    for kind, make, cues in sorts:
        for _ in range(examples):
            what, cue = make(), r.choice(cues)
            head = " ".join(_word(r) for _ in range(r.randint(2, 6))) + (f" {cue}" if cue else "")
            if r.random() < 0.35:  # another item with its own cue shortly before
                _, other, cues_of = r.choice(sorts)
                head = f"{r.choice(cues_of)} {other()}{r.choice([', ', '; ', ' '])}{head if r.random() < 0.5 else r.choice(['on', 'und', 'et', 'y', 'the']) + (f' {cue}' if cue else '')}"
            head += "" if head[-1:] in ('"', "=") and r.random() < 0.7 else r.choice([" ", ": ", " "])
            tail = ('"' if head[-1:] == '"' else "") + r.choice([" ", ", ", ". "]) + f"{_word(r)} {_word(r)}"
            if kind and r.random() < 0.3:  # a number follows at once
                tail = " " + r.choice([card, v4, phone, lambda: _digits(r, r.randint(1, 6))])() + tail
            out.append((head + what + tail, len(head), len(head) + len(what), kind))
    return out


def labelled(examples: list[tuple[str, int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the candidates over the items, and whether each is the item, of its kind and neither more nor much less."""
    x, y = [], []
    for text, start, end, kind in examples:
        for a, k, b in candidates(text):
            if a < end and start < b:
                x.append(features(text, a, b, k))
                y.append(bool(kind) and k == kind and b <= end and min(b, end) - max(a, start) >= 0.9 * (end - start) and a >= start)
    return np.array(x, float), np.array(y, float)


def candidates(text: str) -> list[Span]:
    found: list[Span] = []
    for m in _SPELT.finditer(text):
        if local := _SPELT_LOCAL.search(text, max(0, m.start() - 64), m.start()):
            found.append((local.start(), "email", m.end()))
    if ":" in text:
        found += [(m.start(), "ip", m.end()) for m in _IPV6.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m.start(1), "secret", m.end(1)) for m in _ASSIGNED.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), "secret", m.end()) for m in _PRIVATE.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in GENERATORS:
            for m in pattern.finditer(text):
                found.append((m.start(), kind, m.end()))
                if kind in ("phone", "card"):  # the next number may have been taken along
                    found += [(m.start(), kind, m.start() + g.start()) for g in _LAST_GROUPS.finditer(m.group()) if sum(c.isdigit() for c in m.group()[: g.start()]) >= 7]
    return list(dict.fromkeys(found))


def _kinds(rows: np.ndarray) -> np.ndarray:
    return rows[:, 0].astype(np.int64)


@lru_cache(maxsize=1)
def trained() -> boosting.Judge:
    x, y = labelled(synthetic())
    return boosting.fit_judge(x, y, _kinds(x), len(KINDS), PRECISION, rounds=120, depth=4)


def added_spans(text: str, base: list[Span], model: boosting.Judge) -> list[Span]:
    """Candidates that the model accepts, the more probable first, none over a base span or over each other."""
    found = candidates(text)
    if base and found:
        starts = [s[0] for s in base]
        reach = list(accumulate((s[2] for s in base), max))
        found = [c for c in found if not (k := bisect_left(starts, c[2])) or reach[k - 1] <= c[0]]
    if not found:
        return []
    x = np.array([features(text, a, b, k) for a, k, b in found], float)
    p, ok = model.accepts(x, _kinds(x))
    order = sorted(np.flatnonzero(ok).tolist(), key=lambda i: (-p[i], found[i][0], -found[i][2], KINDS.index(found[i][1])))
    taken: list[Span] = []
    begins: list[int] = []  # of the taken spans, in order; none overlap, so a neighbour tells
    ends: list[int] = []
    for i in order:
        a, _, b = found[i]
        k = bisect_left(begins, b)
        if not k or ends[k - 1] <= a:
            begins.insert(k, a)
            ends.insert(k, b)
            taken.append(found[i])
    return taken


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


#: What no match of a pattern or generator is without: a digit or @ for the base kinds and GENERATORS; the middle of _SPELT, _IPV6, _ASSIGNED and _PRIVATE.
_ANY = r"[0-9@]|[(\[{]\x20?(?:at|AT)|\x20(?:at|AT)\x20|[0-9A-Fa-f]:|(?i:pass(?:word|wd|wort|phrase)|pwd|contrase\x{f1}a|secret|key|token)\x20?[:=]|-----BEGIN"


def find(docs: DataFrame, model: boosting.Judge | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id, counts and digest of the base spans, and all spans."""
    model = model or trained()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            if texts.null_count:
                texts = texts.fill_null("")
            may = pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)
            n = len(texts)
            counts = np.zeros((4, n), np.int64)
            digest, spans, added, total = [empty] * n, [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in np.flatnonzero(may):
                text = texts[int(i)].as_py()
                base = base_spans(text)
                more = added_spans(text, base, model)
                for s in base:
                    counts[BASE_KINDS.index(s[1]), i] += 1
                added[i], total[i] = len(more), len(base) + len(more)
                if base:
                    digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                if base or more:
                    spans[i] = joined(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest), pa.array(spans), pa.array(added), pa.array(total)], names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return common.keep_columns(docs, [id_col, text_col]).mapInArrow(run, f"`{id_col}` {kind}, {counted}, base_sha256 string, spans string, n_added long, n_spans long")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": query}
ORACLES: dict[str, str] = {}
