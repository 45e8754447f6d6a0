from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import pii
from corvane.llm.queries import op4_pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


PIECES = ["a.b@c.d", "@", "x@y", ".", "-", "1.2.3.4", "300.1.1.1", "001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", " ", "é", "12", "(", "a@b.c@d.e", "%+", "\n", "9" * 14]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == brute(text)


def test_query_against_brute_force(spark, sf_dir, few):
    _, texts = few
    for r in op4_pii(spark, sf_dir).collect():
        spans = brute(texts[r.doc_id])
        n = Counter(s[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.mark.parametrize(("text", "kept"), [("IBAN GB82 WEST 1234 5698 7654 32 THE END", True), ("DE89370400440532013000", True), ("DE89370400440532013001", False), ("serial number DE89370400440532013000", False)])
def test_iban_needs_its_checksum_and_context(text, kept):
    spans = [s for s in pii.spans_of(text) if s[0] == "iban"]
    assert bool(spans) is kept
    if kept:
        assert pii.mod97(text[spans[0][1] : spans[0][2]].replace(" ", ""))


def test_context_changes_scores():
    score = lambda t: pii.spans_of(t)[0][3]
    assert score("call +1 555 010 9999") > score("so +1 555 010 9999") > score("order +1 555 010 9999")


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000, "a.b" * 100_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "A1" * 100_000):
        pii.spans_of(text)


def test_odd_rows(odd, empty, clashing):
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find_pii(empty).count() == pii.redact(empty).count() == 0
    out = pii.redact(clashing)
    assert out.columns == clashing.columns
    texts = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert (2, None, None) in texts and (3, "", 0) in texts
    masked = next(t for i, t, _ in texts if i == 5 and "crit" in t)
    assert "[EMAIL]" in masked and "[PHONE]" in masked and "example" not in masked
    assert all(n == len(t) for _, t, n in texts if t is not None)
    assert pii.mask("a@b.c.d", [("email", 0, 5, 1), ("ip", 3, 7, 1)]) == "[EMAIL]"
