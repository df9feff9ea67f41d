from __future__ import annotations

import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from tidewire.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    d = digits(s)[::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": luhn,
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    rules = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return {k: [m.span() for m in r.finditer(text) if ok[k](m[0])] for k, r in rules.items()}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1234567890.@+- ()%é\n:/", max_size=60))
@example("a@b.c@d.e f@g h@i.j. x@y.z-.q 1.2.3.4.5.6.7.8 999.1.1.1.2.3.4 +1 (555) 555-0199 4111 1111-1111 1111")
@example("+1+22 333-4444 5+")
@example("00000.0.0.0255")
def test_base_kinds(text):
    found = pii.scan(text)
    assert {k: found[k] for k in pii.KINDS[:4]} == brute(text)


def test_added_kinds():
    text = "IBAN: GB82 WEST 1234 5698 7654 32; account no. 12345678, bad iban GB82 WEST 1234 5698 7654 33"
    assert [text[a:b] for a, b in pii.scan(text)["account"]] == ["GB82 WEST 1234 5698 7654 32", "12345678"]
    text = "see ftp://joe:pw@host.example:21/x, http://host.example/ and the accountant 1234567"
    found = pii.scan(text)
    assert [text[a:b] for a, b in found["url"]] == ["ftp://joe:pw@host.example:21/x,"]
    assert found["account"] == []


def test_odd_rows(table, odd_rows):
    rows = [*odd_rows, (20, "é a@b.co 🎉 10.0.0.1", None, None)]
    got = pii.find_pii(table(rows)).collect()
    assert len(got) == len(rows)
    (r,) = [r for r in got if r["doc_id"] == 20]
    assert r["base"] == r["spans"] == "email:2:8,ip:11:19" and (r["n_email"], r["n_ip"]) == (1, 1)
    want = {d: brute(t or "") for d, t, _, _ in rows if d}
    for r in got:
        if r["doc_id"]:
            assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [len(want[r["doc_id"]][k]) for k in pii.KINDS[:4]]
    assert pii.find_pii(table([])).count() == 0
