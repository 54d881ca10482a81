"""Personal data by anchor expansion.

An Aho-Corasick automaton reads a text once and reports anchors: at-signs, plus signs, digits,
``://`` and identifier cues (words that announce an account or a secret, key prefixes, street types). Around
each anchor a small deterministic parser expands the boundaries to both sides and validates what it
found. Parsers never look at a character more than a bounded number of times, so the work is linear
even on texts made of anchors.

Base kinds, leftmost and non-overlapping within a kind; a match that fails its check is dropped and
not tried again in another extent:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, every part at most 255
* ``card``   ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass Luhn
* ``phone``  ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Kinds the anchors add: ``url``, ``account`` (an identifier after a cue; IBANs must pass their check
digits), ``key`` (access keys with a known prefix, private key blocks), ``secret`` (a value assigned to a word
like token or password, with a digit in it) and ``address`` (house number, capitalised words and a street
type, in the order that English, French, German and Spanish have).

Defined results: null and the empty text have no spans; positions are code points with the end
exclusive; repeated rows get the same spans each; further columns pass through, and one with the
name of the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "key", "secret", "address")

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False
)

DIGITS = frozenset("0123456789")
ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")

ACCOUNT_CUES = ("iban", "account", "acct", "routing", "passport", "ssn", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential")
STREET_TYPES = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Square", "Court")
#: Street types that stand between number and name, at the end of a name before the number, and before name and number.
STREETS_FR = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai")
STREETS_DE = ("straße", "strasse", "weg", "platz", "allee", "gasse")
STREETS_ES = ("Calle", "Avenida", "Plaza", "Paseo", "Camino")
#: Lengths of what follows a prefix of a key, and whether it is capitals and digits only.
KEY_PREFIXES = {"AKIA": (16, 16, True), "ASIA": (16, 16, True), "AIza": (35, 35, False), "glpat-": (20, 20, False), "npm_": (36, 36, False)}
KEY_PREFIXES |= {f"gh{k}_": (36, 36, False) for k in "pousr"} | {f"xox{k}-": (20, 100, False) for k in "abprs"} | {p: (16, 100, False) for p in ("sk_live_", "sk_test_", "sk-")}
KEY = ALNUM | frozenset("_-")
PEM = "-----BEGIN "

_AFTER_CUE = r"(?![A-Za-z])[ ]?(?:(?:[Nn]o|[Nn]r|[Nn]umber|[Nn]um)\b\.?)?[ :#=]{0,4}"
_ACCOUNT = re.compile(_AFTER_CUE + r"([A-Za-z]{0,3}[0-9](?:[ -]?[0-9]){5,30})(?![A-Za-z0-9])")
_IBAN = re.compile(_AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_STREET = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]?(?: [A-Z][A-Za-z.'-]{0,20}){1,4} $")
_STREET_FR = (re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}(?: ?(?:bis|ter))?,? $"), re.compile(r"(?:(?: (?:de|du|des|la|le|les)\b)|(?: [dl]['’]))* ?[A-ZÀ-Ý][\w'-]{1,20}(?: [A-ZÀ-Ý][\w'-]{1,20}){0,3}"))
_STREET_DE = (re.compile(r"(?<!\w)[A-ZÄÖÜ][\wäöüß-]{1,30}$"), re.compile(r" [0-9]{1,4} ?[a-z]?(?!\w)"))
_STREET_ES = re.compile(r"(?: (?:de|del|la|el|los|las)\b)* [A-ZÁÉÍÓÚÑ]\w{1,20}(?: [A-ZÁÉÍÓÚÑ]\w{1,20}){0,3},? (?:n[.º°]? ?)?[0-9]{1,5}(?!\w)")
_SECRET = re.compile(r"""(?:[A-Za-z0-9_]{0,20})["']?[ ]{0,3}(?:[:=]|=>)[ ]{0,3}["']?([A-Za-z0-9_+/=.~!@#$%^&*-]{8,512})""")
_BEARER = re.compile(r" ([A-Za-z0-9_+/=.-]{16,512})")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,20000}-----END [A-Z ]{0,40}PRIVATE KEY-----")
_URL_END = re.compile(r"[\s<>\"'`]")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("u", 3))
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.title()}:
            a.add_word(form, ("a", len(form)))
    for street in STREET_TYPES:
        a.add_word(street, ("s", len(street)))
    for what, streets in (("f", STREETS_FR), ("g", STREETS_DE), ("e", STREETS_ES)):
        for street in streets:
            a.add_word(street, (what, len(street)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.title()}:
            a.add_word(form, ("t", len(form)))
    for prefix in KEY_PREFIXES:
        a.add_word(prefix, ("k", len(prefix)))
    a.add_word(PEM, ("p", len(PEM)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "").replace("-", "").upper()
    if not (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    value = 0
    for c in s[4:] + s[:4]:
        value = (value * (10 if c in DIGITS else 100) + int(c, 36)) % 97
    return value == 1


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: by kind as in ``KINDS``, then by start."""
    if not text:
        return []
    n = len(text)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_floor = ip_floor = card_floor = phone_floor = url_floor = account_floor = key_floor = secret_floor = address_floor = 0
    for last, (what, size) in automaton().iter(text):
        if what == "d":
            if last >= ip_floor:
                ip_floor = _ip(text, last, n, out["ip"])
            if last >= card_floor:
                card_floor = _card(text, last, n, out["card"])
        elif what == "@":
            start = last
            while start > email_floor and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (end := _domain(text, last + 1, n)):
                out["email"].append((start, end))
                email_floor = end
            else:
                email_floor = max(email_floor, last + 1)
        elif what == "+":
            if last >= phone_floor:
                phone_floor = _phone(text, last, n, out["phone"])
        elif what == "u":
            at = last - 2
            start = at
            while start > max(url_floor, at - 16) and text[start - 1] in ALNUM:
                start -= 1
            if start < at and at >= url_floor:
                stop = _URL_END.search(text, last + 1)
                end = stop.start() if stop else n
                url_floor = end
                while end > last + 1 and text[end - 1] in ".,;:!?)]}":
                    end -= 1
                if end > last + 1:
                    out["url"].append((start, end))
        elif what == "a":
            start = last - size + 1
            iban = text[start : last + 1].lower() == "iban"
            if start >= account_floor and text[max(0, start - 1) : start] not in ALNUM and (m := (_IBAN if iban else _ACCOUNT).match(text, last + 1)):
                if not iban or _iban(m[1]):
                    out["account"].append(m.span(1))
                    account_floor = m.end(1)
        elif what == "k":
            start = last - size + 1
            least, most, capitals = KEY_PREFIXES[text[start : last + 1]]
            end = last + 1
            while end < n and end - last <= most + 1 and text[end] in KEY:
                end += 1
            body = text[last + 1 : end]
            if start >= key_floor and least <= len(body) <= most and text[max(0, start - 1) : start] not in ALNUM and (ALNUM.issuperset(body) and body == body.upper() if capitals else not DIGITS.isdisjoint(body)):
                out["key"].append((start, end))
                key_floor = end
        elif what == "p":
            start = last - size + 1
            if start >= key_floor and (m := _PEM.match(text, start)):
                out["key"].append(m.span())
                key_floor = m.end()
        elif what == "t":
            start = last - size + 1
            if start >= secret_floor and text[max(0, start - 1) : start] not in ALNUM:
                m = _SECRET.match(text, last + 1) or (_BEARER.match(text, last + 1) if text[start : last + 1].lower() == "bearer" else None)
                if m and not DIGITS.isdisjoint(m[1]):
                    out["secret"].append(m.span(1))
                    secret_floor = m.end(1)
        elif what == "f":
            start = last - size + 1
            if start >= address_floor and (a := _STREET_FR[0].search(text[max(0, start - 12) : start])) and (m := _STREET_FR[1].match(text, last + 1)):
                out["address"].append((max(0, start - 12) + a.start(), m.end()))
                address_floor = m.end()
        elif what == "g":
            start = last - size + 1
            if start >= address_floor and (m := _STREET_DE[1].match(text, last + 1)) and (a := _STREET_DE[0].search(text[max(0, start - 32) : start])):
                out["address"].append((max(0, start - 32) + a.start(), m.end()))
                address_floor = m.end()
        elif what == "e":
            start = last - size + 1
            if start >= address_floor and text[max(0, start - 1) : start] not in ALNUM and (m := _STREET_ES.match(text, last + 1)):
                out["address"].append((start, m.end()))
                address_floor = m.end()
        else:
            start = last - size + 1
            if start >= address_floor and text[last + 1 : last + 2] not in ALNUM and (m := _STREET.search(text[max(0, start - 100) : start])):
                out["address"].append((max(0, start - 100) + m.start(), last + 1))
                address_floor = last + 1
    return [(k, s, e) for k in KINDS for s, e in sorted(out[k])]


def _domain(text: str, at: int, n: int) -> int:
    """The end of a domain that starts here, 0 if there is none."""
    end, dots = 0, 0
    while True:
        start = at
        while at < n and text[at] in LABEL:
            at += 1
        if at == start:
            return end
        if dots:
            end = at
        if at >= n or text[at] != ".":
            return end
        at, dots = at + 1, dots + 1


def _digits(text: str, at: int, n: int) -> int:
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def _ip(text: str, at: int, n: int, out: list) -> int:
    """Four groups from here; fewer mean that no group of this chain starts a match. Returns where to go on."""
    start, parts = at, []
    while True:
        end = _digits(text, at, n)
        parts.append(text[at:end])
        if len(parts) == 4:
            if all(map(_at_most_255, parts)):
                out.append((start, end))
            return end
        if end + 1 >= n or text[end] != "." or text[end + 1] not in DIGITS:
            return end
        at = end + 1


def _card(text: str, at: int, n: int, out: list) -> int:
    start = at
    end = at = _digits(text, at, n)
    while at + 1 < n and text[at] in " -" and text[at + 1] in DIGITS:
        end = at = _digits(text, at + 1, n)
    if end - start >= 13:
        digits = text[start:end].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((start, end))
    return end


def _phone(text: str, at: int, n: int, out: list) -> int:
    if at + 3 >= n or text[at + 1] not in DIGITS:
        return at + 1
    end = at + 2
    while end < n and text[end] in PHONE:
        end += 1
    stop = end
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return stop
    if 9 <= sum(map(DIGITS.__contains__, text[at:end])) <= 15:
        out.append((at, end))
    return end


def find(df: DataFrame, text: str = "text", spans: str = "spans", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (without ``drop``) with the spans of its text."""
    out = T.StructType([f for f in df.schema.fields if f.name not in (spans, *drop)])
    keep = [f.name for f in out.fields]
    kind = pa.list_(pa.struct([pa.field("kind", pa.string()), pa.field("start", pa.int64()), pa.field("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "")] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(got, kind)], names=[*keep, spans])

    return df.mapInArrow(run, out.add(spans, SPANS))


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest names the place."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out.append(f"{text[at:start]}<{kind.upper()}>")
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the personal data of its text masked; null stays null."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            got = [t if not t or not (s := find_spans(t)) else mask_text(t, s) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, df.schema)


def joined(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
