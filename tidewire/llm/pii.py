"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits,
schemes and words that announce an identifier. At each anchor a small parser finds where the datum
begins and ends and checks it: part ranges, digit counts, Luhn, IBAN remainder.

Base kinds are email, ip, card and phone, leftmost and not overlapping per kind; a failing match
is dropped and not tried again in another form. The method adds two kinds: ``account`` (an
identifier after a cue word) and ``url`` (an address that carries user information).
Positions are code points, the end exclusive. The work is one map over the rows, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import col, text_or_empty

KINDS = ("email", "ip", "card", "phone", "account", "url")

# The patterns of the base kinds.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
CUES = ("iban", "account", "acct", "passport", "ssn", "konto", "compte", "cuenta")
SCHEMES = ("://",)
AFTER_CUE = re.compile(
    r"[ \t]*(?:(?:no|nr|num|number|id)\b\.?)?[ \t]*[:=#]?[ \t]*"
    r"([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}|[0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9])",
    re.IGNORECASE | re.ASCII,
)
AUTHORITY = re.compile(r"://[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9.-]+(:[0-9]+)?(/[^\s<>\"]*)?")
SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

SCHEMA = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string"

_automaton = None


def automaton():
    """The anchors, built once per worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for d in DIGITS:
            a.add_word(d, ("digit", 1))
        for s in SCHEMES:
            a.add_word(s, ("scheme", len(s)))
        for c in CUES:
            for form in {c, c.upper(), c.capitalize()}:
                a.add_word(form, ("cue", len(c)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def card_ok(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def phone_ok(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def account_ok(s: str) -> bool:
    """Plain numbers of 6 to 17 digits; with letters, an IBAN with the right remainder."""
    body = s.replace(" ", "").replace("-", "").upper()
    if body.isdigit():
        return 6 <= len(body) <= 17
    if not 15 <= len(body) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def scan(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in one text."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton().iter(text):
        at = last - length + 1
        if kind == "digit":
            # A digit run is tried once from its first free digit: if the structure fails there,
            # it fails from every later digit of the run.
            if at >= done["ip"] and (at == done["ip"] or text[at - 1] not in DIGITS):
                if m := IP.match(text, at):
                    done["ip"] = m.end()
                    if ip_ok(m[0]):
                        found["ip"].append(m.span())
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                if card_ok(m[0]):
                    found["card"].append(m.span())
        elif kind == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if phone_ok(m[0]):
                    found["phone"].append(m.span())
        elif kind == "cue":
            if at and text[at - 1].isalnum():
                continue
            if (m := AFTER_CUE.match(text, last + 1)) and m.start(1) >= done["account"]:
                if account_ok(m[1]):
                    done["account"] = m.end(1)
                    found["account"].append(m.span(1))
        else:
            start = at
            while start > done["url"] and text[start - 1] in SCHEME_CHARS:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := AUTHORITY.match(text, at)):
                done["url"] = m.end()
                found["url"].append((start, m.end()))
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, a count per base kind, the ``base`` spans and all ``spans`` of every row.

    Null counts as empty and has no spans. Repeated rows each give a row. Other columns are not
    looked at, whatever their names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS[:4]]
            base = pa.array([listed(r, KINDS[:4]) for r in rows], pa.string())
            spans = pa.array([listed(r, KINDS) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, base, spans],
                names=["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", "spans"],
            )

    source = docs.select(col(docs, doc_id).alias("doc_id"), text_or_empty(col(docs, text)).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
