"""Base spans against a plain scan, context spans on planted patterns."""

import hashlib
import re

from lexweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


TEXTS = [
    "mail a.b@c.example.org or a@b.c_d@e.f, not x@y nor @@ z@@q.r",
    "1.2.3.4.5.6.7.8 300.1.2.3 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111  1111 1111 1111",
    "+1 (234) 567-8901 +12 +44 20 7946 0958. +1 2345 6789 0123 4567",
    "é😀 1.2.3.4 😀 a@b.co é +49 89 1234567",
    "9" * 40_000 + " " + "a" * 40_000 + " " + "( " * 9_000 + "1 " * 5_000,
    "+1" + " " * 20_000 + "a@b.co " * 400,
    "",
    None,
]


def test_base_spans(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "", "")] + [(1, TEXTS[1], "", "")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, _hash string")
    found = pii.digest(pii.detect(table)).collect()
    assert len(found) == len(rows)
    for row in found:
        text = TEXTS[0] if row.doc_id is None else TEXTS[row.doc_id]
        want = base_spans(text)
        listed = [":".join(map(str, s)) for s in want]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert set(listed) <= set(row.spans.split(",") if row.spans else [])


def test_contexts_discover_only_in_confident_patterns(spark):
    rows = [(i, f"filler {i} text. My phone number is +1 (555) 010-{1000 + i} thanks") for i in range(12)]
    rows += [(50, "My phone number is (555) 010-7777 thanks"), (51, "the total was (555) 010-7777 units")]
    rows += [(60 + i, f"order code 555 010 {2000 + i} shipped") for i in range(9)]
    found = {r.doc_id: r for r in pii.digest(pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[50].n_phone == 0
    assert found[50].spans == "phone:19:33"
    assert found[51].spans == ""
    assert all(found[60 + i].spans == "" for i in range(9))
    assert all(found[i].spans.startswith("phone:") for i in range(12))


def test_redaction(spark):
    rows = [(1, "a@b.co 1.2.3.4 x", "k", 1), (1, "a@b.co 1.2.3.4 x", "k", 1), (None, None, None, None), (2, "plain", "k", 1), (3, "é +4111 1111 1111 1111 é", "k", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row string, kind int")
    out = pii.redact(table)
    assert out.columns == table.columns
    texts = sorted((r.text for r in out.collect()), key=str)
    assert texts[:1] == [None][:0] + texts[:1] and texts.count("[EMAIL] [IP] x") == 2
    assert "plain" in texts and None in texts and "é +[CARD] é" in texts


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.detect(empty)).count() == 0
    assert pii.redact(empty).count() == 0
