"""Personal data found by anchor expansion: an Aho-Corasick pass, then local parsers around each hit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, whole_text

#: Kinds in the order that breaks ties of position: the base ones, then those that cues add.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "secret", "iban", "ssn", "account", "url")
#: Words that announce a credential or an account, in lower case; the text is searched without regard to ASCII case.
PASSWORD_CUES = ("password", "passwd", "passphrase", "pwd")
SECRET_CUES = (
    "token", "secret", *(f"{a}{gap}key" for a in ("api", "access", "private", "auth", "encryption", "signing") for gap in ("", "_", "-", " ")),
)
#: Beginnings of credentials that name themselves, as their issuers publish them, with what follows.
TOKEN_FORMS = {
    "ghp_": "[A-Za-z0-9]{30,}", "gho_": "[A-Za-z0-9]{30,}", "ghs_": "[A-Za-z0-9]{30,}", "ghu_": "[A-Za-z0-9]{30,}", "github_pat_": "[A-Za-z0-9_]{22,}", "glpat-": "[A-Za-z0-9_-]{20,}",
    "xoxb-": "[A-Za-z0-9-]{10,}", "xoxp-": "[A-Za-z0-9-]{10,}", "sk_live_": "[A-Za-z0-9]{16,}", "rk_live_": "[A-Za-z0-9]{16,}", "AKIA": "[A-Z0-9]{16}(?![A-Za-z0-9])",
    "AIza": "[A-Za-z0-9_-]{35}", "npm_": "[A-Za-z0-9]{30,}", "eyJ": r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "-----BEGIN ": "[A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*-----)?",
}
#: Words before the number of a bank account, and before a branch's code.
BANK_CUES = ("account number", "account no", "account #", "account id", "bank account", "acct", "a/c", "kontonummer", "sort code", "routing number", "bankleitzahl")
#: Names of query values that tell of a person or let one in.
QUERY_NAMES = frozenset("access_token api_key apikey auth client_secret email key mail pass passwd password phone pwd secret session sessionid sid sig signature token user userid username".split())
ACCOUNT_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn"}

_UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@\"'<>]++(?=@)")
_NAME = re.compile(r"[A-Za-z0-9_-]*+")
_SET = re.compile(r"[\"']?[ ]?(?::=|=>|(=)|:|is\b)[ ]?([\"'])?")
_BEARER = re.compile(r"[ ]++((?=[A-Za-z._~+/-]*+[0-9])[A-Za-z0-9._~+/-]{16,}+=*+)")
_BANK = re.compile(r"(?:[ :#.=()-]|(?i:number|no|nr|is)(?![A-Za-z])){0,12}+([0-9](?:[ -]?[0-9])*+)(?![A-Za-z0-9])")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_ADDRESS = re.compile(r"[^\s\"'<>\\^`{|}]++")
_HOST = re.compile(r"(?:[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?\.)*[A-Za-z0-9_](?:[A-Za-z0-9_-]*[A-Za-z0-9_])?|\[[0-9A-Fa-f:.]+\]")
_VALUE = re.compile(r"[A-Za-z0-9_./+=~-]*+")
_PASSWORD = re.compile(r"[^\s\"'<>&;,]*+")
_QUOTED = re.compile(r"[^\s\"']*+")
_IBAN = re.compile(r"[^A-Za-z0-9\n]*+(?:(?i:number|code|no\.?)[^A-Za-z0-9\n]*+)?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+)")
_GAP = re.compile(r"[^0-9\n]*+")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

SPAN = "struct<kind:string,start:int,end:int,base:boolean>"


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789")]:
        found.add_word(mark, (kind, len(mark), ""))
    for form in TOKEN_FORMS:
        found.add_word(form.lower(), ("form", len(form), form))
    found.add_word("bearer", ("bearer", 6, ""))
    for cue in BANK_CUES:
        found.add_word(cue, ("bank", len(cue), ""))
    for cue, kind in [*((c, "password") for c in PASSWORD_CUES), *((c, "secret") for c in SECRET_CUES), *ACCOUNT_CUES.items()]:
        found.add_word(cue, ("cue", len(cue), kind))
    found.make_automaton()
    return found


class _Run:
    """Runs of characters that a pattern takes, each looked at once however many places in it are asked for."""

    def __init__(self, pattern: re.Pattern, text: str) -> None:
        self.pattern, self.text = pattern, text
        self.begin = self.end = 0
        self.digit = -1  # where its last digit stands

    def end_from(self, at: int) -> int:
        if not self.begin <= at < self.end:
            self.begin, self.end = at, self.pattern.match(self.text, at).end()
            self.digit = max(self.text.rfind(d, at, self.end) for d in "0123456789")
        return self.end


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_length(text: str) -> int:
    """Characters of the longest beginning that is an IBAN, 0 if none: words in capitals may follow one."""
    for end in range(len(text), 14, -1):
        bare = text[:end].replace(" ", "")
        if text[end - 1] != " " and not text[end : end + 1].isalnum() and 15 <= len(bare) <= 34:
            if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                return end
    return 0


_FORMS = {form: re.compile(re.escape(form) + rest) for form, rest in TOKEN_FORMS.items()}


def _address_end(text: str, begin: int) -> int:
    """Where an address that goes on at ``begin`` ends: before white space and quotes, without the sentence's punctuation or a bracket it does not open."""
    end = _ADDRESS.match(text, begin).end() if begin < len(text) and _ADDRESS.match(text, begin) else begin
    closing = {")": "(", "]": "["}
    spare = {c: text.count(c, begin, end) - text.count(o, begin, end) for c, o in closing.items()}
    while end > begin and (text[end - 1] in ".,;:!?" or spare.get(text[end - 1], 0) > 0):
        if text[end - 1] in spare:
            spare[text[end - 1]] -= 1
        end -= 1
    return end


def _address_tells(address: str) -> bool:
    """Whether an address behind its scheme is sound and carries user info or a query value that tells of a person."""
    authority, _, rest = re.match(r"([^/?#]*)([/?#]?)(.*)", address, re.S).groups()
    info, at, place = authority.rpartition("@")
    host, _, port = place.partition(":") if not place.startswith("[") else (place.partition("]")[0] + "]", ":", place.partition("]")[2].lstrip(":"))
    if not _HOST.fullmatch(host) or port and not (port.isascii() and port.isdigit() and len(port) <= 5 and int(port) <= 65535):
        return False
    query = address.partition("?")[2].partition("#")[0] if "?" in address else ""
    pairs = (pair.partition("=") for pair in re.split("[&;]", query))
    return bool(at and info) or any(name.lower() in QUERY_NAMES and value for name, _, value in pairs)


def _ssn_valid(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def find_spans(text: str, automaton) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` in code points, end exclusive, by start and then kind.

    Base kinds are leftmost and do not overlap within a kind; a candidate that fails its check is passed
    over whole. Cue kinds: ``login``, user info between a scheme and an at-sign; ``url``, the whole of an address with a sound host and port
    that carries user info or a query value named in QUERY_NAMES, up to white space, quotes or the sentence's punctuation; ``secret``, what is assigned to a name
    with a credential word in it (a digit and 12 characters, or 8 in quotes; after a password word 6 characters, with a digit unless
    quoted or set with an equals sign), what follows "bearer", and credentials of TOKEN_FORMS; ``iban`` and ``ssn``, numbers after their name on its
    line; ``account``, 6 to 18 digits right after one of BANK_CUES. No length of a value is capped.
    Work is proportional to the text: a parser starts at a hit that its kind has not consumed and moves right,
    or left up to its last match.
    """
    spans: list[tuple[str, int, int, bool]] = []
    email_end = ip_end = card_end = phone_end = value_end = gap_end = address_end = bank_end = 0
    name, plain, password, quoted_run = (_Run(p, text) for p in (_NAME, _VALUE, _PASSWORD, _QUOTED))
    folded = text.lower()
    if len(folded) != len(text):  # a letter became two: fold ASCII only
        folded = text.translate(_UPPER)
    for last, (mark, width, kind) in automaton.iter(folded):
        at = last - width + 1
        if mark == "digit":
            if at >= card_end:
                m = _DIGITS.match(text, at)
                card_end = m.end() if m else at + 1
                if m and 14 <= m.end() - at:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, card_end, True))
            if at >= ip_end:
                ip_end = (m := _DOTTED.match(text, at)).end()
                if ip_end - at >= 7 and m[0].count(".") >= 3:
                    parts = m[0].split(".")
                    start = at
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = start + sum(map(len, four)) + 3
                        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
                            spans.append(("ip", start, end, True))
                        start = end + 1
        elif mark == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                spans.append(("email", start, email_end, True))
        elif mark == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", at, phone_end, True))
        elif mark == "scheme":
            if m := _USERINFO.match(text, last + 1):
                spans.append(("login", m.start(), m.end(), False))
            if at >= address_end:
                start = at
                while start > address_end and text[start - 1] in _SCHEME:
                    start -= 1
                while start < at and not (text[start].isascii() and text[start].isalpha()):
                    start += 1
                address_end = max(last + 1, _address_end(text, last + 1))
                if start < at and _address_tells(text[last + 1 : address_end]):
                    spans.append(("url", start, address_end, False))
        elif mark == "form":
            if at >= value_end and not text[at - 1 : at].isalnum() and (m := _FORMS[kind].match(text, at)):
                value_end = m.end()
                spans.append(("secret", at, value_end, False))
        elif mark == "bearer":
            if last + 1 >= value_end and (m := _BEARER.match(text, last + 1)):
                value_end = m.end()
                spans.append(("secret", m.start(1), value_end, False))
        elif mark == "bank":
            if last + 1 >= bank_end and (m := _BANK.match(text, last + 1)):
                bank_end = m.end()
                if 6 <= sum(c.isdigit() for c in m[1]) <= 18:
                    spans.append(("account", m.start(1), m.end(1), False))
        elif kind in ("secret", "password"):
            if at < value_end or not (m := _SET.match(text, name.end_from(last + 1))):
                continue
            quoted = bool(m[2])
            run = plain if kind == "secret" else quoted_run if quoted else password
            length = run.end_from(m.end()) - m.end()
            if length >= (6 if kind == "password" else 8 if quoted else 12) and (run.digit >= m.end() or kind == "password" and (quoted or bool(m[1]))):
                value_end = m.end() + length
                spans.append(("secret", m.end(), value_end, False))
        elif kind == "iban":
            if (m := _IBAN.match(text, last + 1)) and (length := _iban_length(m[1])):
                spans.append(("iban", m.start(1), m.start(1) + length, False))
        elif last + 1 >= gap_end:  # words before the same number find the same one
            gap_end = _GAP.match(text, last + 1).end()
            if (m := _SSN.match(text, gap_end)) and _ssn_valid(m[0]):
                spans.append(("ssn", m.start(), m.end(), False))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans``: one row per row of ``docs``, the spans as an array of SPAN.

    A null or empty text has none (an empty array); texts are read whole; repeated rows get equal results;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for part in sliced(batches, 1):
            rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in find_spans(t.as_py(), automaton)] for t in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(rows, kind)], names=["id", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("__text")).mapInArrow(run, f"id {id_kind}, spans array<{SPAN}>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; overlapping spans merge."""
    at = docs.columns.index(text_col)

    def masked(text: str | None, automaton) -> str | None:
        out, done = [], 0
        for kind, start, end, _ in find_spans(text or "", automaton):
            if start >= done:
                out += [text[done:start], f"[{kind}]"]
            done = max(done, end)
        return "".join(out) + text[done:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for part in sliced(batches, at):
            column = pa.array([masked(t.as_py(), automaton) for t in part.column(at)], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), column)

    return docs.mapInArrow(run, docs.schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
