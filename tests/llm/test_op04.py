import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from terrabin.llm import op04_anchor_pii as op

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and op.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


MACHINE = op.automaton()


@settings(max_examples=600, deadline=None)
@given(st.text("a1.@+- 2(34:\né/%", max_size=60))
def test_base_kinds_equal_the_patterns(text):
    assert [x for x in op.find(text, MACHINE) if x[1] < 4] == brute(text)


def test_documents(docs, rows):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in op.personal_data(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        b = brute(t or "")
        want[(i, *(sum(k == n for _, k, _ in b) for n in range(4)), hashlib.sha256(op.join(b).encode()).hexdigest())] += 1
    assert got == want


def test_added_kinds():
    text = 'see https://user@host.example/x?y=1). token = "0f3a9b2c7d" and password: short, api_key=ABCDEF123456'
    found = {(op.KINDS[k], text[s:e]) for s, k, e in op.find(text, MACHINE)}
    assert ("url", "https://user@host.example/x?y=1") in found and ("secret", "0f3a9b2c7d") in found and ("secret", "ABCDEF123456") in found
    assert not any(k == "secret" and "short" in v for k, v in found)


def found(text, kind):
    return [text[s:e] for s, k, e in op.find(text, MACHINE) if op.KINDS[k] == kind]


def test_schemes_are_whole():
    assert found("see chrome-extension://abcdef/x.html, 12http://a.b", "url") == ["chrome-extension://abcdef/x.html", "http://a.b"]
    assert found("://x 1://y", "url") == []


def test_accounts():
    assert found("IBAN: GB29 NWBK 6016 1331 9268 19 and more", "account") == ["GB29 NWBK 6016 1331 9268 19"]
    assert found("Iban DE89370400440532013000.", "account") == ["DE89370400440532013000"]
    assert found("IBAN: GB28 NWBK 6016 1331 9268 19", "account") == []
    assert found("SSN 123-45-6789, ssn: 000-12-3456, Ssn=666-12-3456, SSN 123-456789", "account") == ["123-45-6789"]
    assert found("Account Number: 1234 5678 90; account number 12345678; ACCOUNT NO. 998877", "account") == ["1234 5678 90", "12345678", "998877"]
    assert found("account number of people 12345678, discount no 12345678, account nothing 123456", "account") == []


def test_cues_in_any_case():
    assert found("Api_Key=ABCDEF123456 API_KEY: abc123456789 authToken=abc1234567", "secret") == ["ABCDEF123456", "abc123456789", "abc1234567"]
    assert found("\u0130stanbul token=abc1234567", "secret") == ["abc1234567"]


def test_linear_in_length():
    assert len(op.find("1" * 20000 + "@" * 20000 + "+1" * 20000, MACHINE)) < 10
    assert op.find("".join(random.Random(1).choice("a.") for _ in range(50000)), MACHINE) == []


def test_empty_table(no_docs):
    assert op.personal_data(no_docs).count() == 0
