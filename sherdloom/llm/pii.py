"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, schemes,
plus signs, digits and identifier cues.  Small deterministic parsers expand each
anchor to its boundaries and validate what they find.  Base kinds (email, ip, card,
phone) give exactly the leftmost, non-overlapping matches of their patterns; the cues
add spans: telephone numbers, logins and profile pages behind a scheme, handles behind
an at-sign, spelled-out addresses, IBANs with right check digits, numbers behind a cue
such as SSN, passwords and keys, and postal addresses by their street.  Cues are found
in any case of A-Z.

Defined results: null and empty texts have no spans; repeated rows are searched each
for itself; a phone candidate or digit run that fails its check is dropped without
another try; a text is read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col

KINDS = ("email", "ip", "card", "phone", "account", "address", "place", "secret")  # in the order of ties
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:?#<>\"']+:[^\s/@?#<>\"']+@[A-Za-z0-9.-]+")
_TEL = re.compile(r"[0-9][0-9.() -]{5,}[0-9]")
_SPELLED = re.compile(
    r"[ \t]*([A-Za-z0-9-]+(?:[ \t]*[\[({]dot[\])}][ \t]*[A-Za-z0-9-]+)+)", re.I
)
_GAP = re.compile(r"[ \t:=#-]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"(?:[ \t]*(?:no\.?|number|nr\.?|#))?[ \t]*[:=#]?[ \t]*([A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,16})", re.I)
_PLAIN = re.compile(r"[ \t]*([A-Za-z0-9-]+(?:[ \t]+dot[ \t]+[A-Za-z0-9-]+)*[ \t]+dot[ \t]+[A-Za-z]{2,10})(?![A-Za-z0-9])", re.I)
_HANDLE = re.compile(r"[A-Za-z_](?:[A-Za-z0-9_]|[.-](?=[A-Za-z0-9_])){2,38}(?![A-Za-z0-9_@])")
_PROFILE = re.compile(
    r"(?:www\.|m\.|mobile\.)?(?:(?:twitter|x|github|gitlab|instagram|facebook)\.com/|t\.me/|linkedin\.com/in/"
    r"|reddit\.com/u(?:ser)?/|(?:tiktok|youtube|medium)\.com/@)"
    r"([A-Za-z0-9_](?:[A-Za-z0-9_]|[.-](?=[A-Za-z0-9_])){1,38})(?![A-Za-z0-9_])", re.I,
)
_SECRET = re.compile(r"[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*[\"']?([^\s\"',;]{6,})")
_CLASSES = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
# Forms of published kinds of keys.
_KEY = re.compile(
    r"(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,}|[sr]k_live_[0-9A-Za-z]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----)(?![A-Za-z0-9])"
)
_RUN = re.compile(r"[A-Za-z0-9_-]+")
_NUMBERED = re.compile(r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]?(?: [A-Z][\w'.-]{0,30}){1,4}$")
_TOWN = re.compile(
    r"\.?(?:,? (?:Apt|Suite|Flat|Unit)\.? [0-9A-Za-z]{1,6})?"
    r"(?:,\s[A-Z][a-z\u00C0-\u00FF'-]+(?: [A-Z][a-z\u00C0-\u00FF'-]+){0,2}"
    r"(?:,? (?:[A-Z]{2} [0-9]{5}(?:-[0-9]{4})?|[A-Z]{1,2}[0-9][0-9A-Z]?(?: [0-9][A-Z]{2})?|[0-9]{4,6})(?![0-9A-Za-z]))?)?"
)
_HOUSE = re.compile(r"\.? [0-9]{1,4}[a-z]?(?![0-9A-Za-z])(?:, ?[0-9]{4,5} [A-Z\u00C0-\u00DE][\w-]+)?")
STREET = 64  # characters before a street word that hold its number and name
# Cues in lower case; names that no account has; at-words of programs and style sheets.
CUES = {
    "iban": "iban",
    "number": "ssn|social security|passport|tax id|account number|account no|routing number|driver's license"
    "|account|acct|konto|kontonummer|kundennummer|customer id|cuenta|compte",
    "tel": "tel:", "login": "://", "spelled": "[at]|(at)|{at}", "plain": " at ",
    "secret": "password|passwd|passphrase|pwd|api_key|api-key|apikey|secret_key|client_secret|secret|access_token"
    "|accesstoken|auth_token|authtoken|token",
    "key": "akia|asia|ghp_|gho_|ghu_|ghs_|ghr_|xoxa-|xoxb-|xoxp-|sk_live_|rk_live_|aiza|eyj|-----begin",
    "street": " street| st| road| rd| avenue| ave| lane| drive| boulevard| blvd| square| terrace",
    "house": "straße|strasse|str.",
}
NO_ACCOUNT = set("about explore features hashtag help home intent login pricing search settings share signup topics".split())
NO_HANDLE = set(
    "author charset classmethod deprecated font-face import interface keyframes media override page param property "
    "return returns see since staticmethod supports throws".split()
)
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "digit")
    a.add_word("@", "at")
    a.add_word("+", "plus")
    for kind, words in CUES.items():
        for w in words.split("|"):
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Finder:
    """Spans (kind, start, end) of one text after another."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def base(self, text: str, anchors: list) -> list[tuple[str, int, int]]:
        out = []
        mail = ip = card = phone = ip_run = 0  # where the next match of each kind may begin
        for at, what in anchors:
            if what == "at":
                start = at
                while start > mail and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    out.append(("email", start, m.end()))
                    mail = m.end()
            elif what == "digit":
                if at >= card and (m := _CARD.match(text, at)):
                    card = m.end()
                    digits = re.sub("[ -]", "", m[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card))
                if at >= ip and at >= ip_run:
                    if m := _IP.match(text, at):
                        ip = m.end()
                        # At most three digits count after leading zeros.
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                            out.append(("ip", at, ip))
                    else:  # no later digit of this run begins a match either
                        ip_run = _DIGITS.match(text, at).end()
            elif what == "plus" and at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, phone))
        return out

    def more(self, text: str, anchors: list) -> list[tuple[str, int, int]]:
        """What identifier cues, schemes and spelled-out signs add."""
        out = []
        secret = key = key_run = 0  # where the next value, key or run of a failed key may begin
        for at, what in anchors:
            if what == "at":
                before = text[at - 1] if at else " "
                if not (before in _LOCAL or before.isalnum() or before in "@/"):
                    m = _HANDLE.match(text, at + 1)
                    if m and m[0].lower() not in NO_HANDLE and not (m.end() < len(text) and text[m.end()].isalnum()):
                        out.append(("account", at, m.end()))
            if isinstance(what, str):
                continue
            kind, width = what
            end, start = at + 1, at + 1 - width
            before = text[start - 1] if start else " "
            if kind == "login":
                if m := _LOGIN.match(text, end):
                    out.append(("account", end, m.end()))
                elif (m := _PROFILE.match(text, end)) and m[1].lower() not in NO_ACCOUNT:
                    out.append(("account", end, m.end()))
            elif kind in ("spelled", "plain"):
                m = (_SPELLED if kind == "spelled" else _PLAIN).match(text, end)
                if not m:
                    continue
                stop = start
                while stop and text[stop - 1] in " \t":
                    stop -= 1
                first = stop
                while first and text[first - 1] in _LOCAL:
                    first -= 1
                if first < stop:
                    out.append(("address", first, m.end(1)))
            elif kind == "street":
                if not text[end : end + 1].isalnum() and (m := _NUMBERED.search(text, max(0, start - STREET), start)):
                    out.append(("place", m.start(), _TOWN.match(text, end).end()))
            elif kind == "house":
                if m := _HOUSE.match(text, end):
                    first, least = start, max(0, start - STREET)
                    while first > least and (text[first - 1].isalpha() or text[first - 1] == "-"):
                        first -= 1
                    if text[first].isupper():
                        out.append(("place", first, m.end()))
            elif before.isalnum():
                continue  # the cue is the end of a longer word
            elif kind == "key":
                if start < key or start < key_run and text[start] in "eE":
                    continue
                if m := _KEY.match(text, start):
                    out.append(("secret", start, m.end()))
                    key = m.end()
                elif text[start] in "eE":  # no later token in this run has its dots either
                    key_run = _RUN.match(text, start).end()
            elif kind == "secret":
                if start >= secret and (m := _SECRET.match(text, end)):
                    secret = m.end()
                    value = m[1].rstrip(".!?)]}")
                    if len(value) >= 6 and sum(bool(c.search(value)) for c in _CLASSES) > 1:
                        out.append(("secret", m.start(1), m.start(1) + len(value)))
            elif kind == "tel":
                gap = _GAP.match(text, end).end()
                if (m := _TEL.match(text, gap)) and 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", gap, m.end()))
            elif kind == "number":
                if m := _NUMBER.match(text, end):
                    out.append(("account", m.start(1), m.end(1)))
            elif kind == "iban":
                gap = _GAP.match(text, end).end()
                if m := _IBAN.match(text, gap):
                    # The longest prefix with right check digits; countries differ in length.
                    for stop in range(m.end(), gap + 14, -1):
                        plain = text[gap:stop].replace(" ", "")
                        if text[stop - 1] != " " and 15 <= len(plain) <= 34 and iban_ok(plain):
                            out.append(("account", gap, stop))
                            break
        return out

    def find(self, text: str) -> tuple[list, list]:
        anchors = [(at, what) for at, what in self.anchors.iter(text.translate(_LOWER))]
        if not anchors:
            return [], []
        base = self.base(text, anchors)
        taken = set(base)
        return _sorted(base), _sorted({*base, *(s for s in self.more(text, anchors) if s not in taken)})


def _sorted(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): spans of every text as arrays of (kind, start, end)."""
    source = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            base, every = [], []
            for t in b.column(1):
                x, y = finder.find(t.as_py() or "")
                base.append([dict(zip(("kind", "start", "end"), s)) for s in x])
                every.append([dict(zip(("kind", "start", "end"), s)) for s in y])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(base, span), pa.array(every, span)], names=["doc_id", "base", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = "array<struct<kind:string,start:int,end:int>>"
    return source.mapInArrow(run, f"doc_id {kind}, base {each}, spans {each}")


def report(docs: DataFrame) -> DataFrame:
    found = find_spans(docs)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    def text(name):
        return F.array_join(
            F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts with every span replaced by its kind in angle brackets."""
    source = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            out = []
            for t in b.column(1):
                text, at, parts = t.as_py(), 0, []
                for kind, start, end in finder.find(text or "")[1]:
                    if start >= at:
                        parts += [text[at:start], f"<{kind}>"]
                    at = max(at, end)
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
