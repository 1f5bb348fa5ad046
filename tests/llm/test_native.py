"""Exact dedup, secrets, personal data, mixing: edge cases against plain versions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leafloom.llm import exact_dedup, mixing, pii, secret_scan

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 1, "x") for i, t, s in rows], DOCS)


ROWS = [(1, "Same", "a"), (2, "same", "a"), (3, None, "b"), (4, "", "b"), (5, "É", None), (6, "é", None), (2, "same", "a"), (None, "other", "a"), (None, "other", "a")]


def plain_groups(rows):
    norm = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t, _ in rows]
    out = []
    for (i, _, _), n in zip(rows, norm, strict=True):
        ids = [r[0] for r, m in zip(rows, norm, strict=True) if m == n]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))], ids=["sha", "weak"])
def test_exact_groups(spark, digest):
    """A digest under which different texts meet changes nothing."""
    got = exact_dedup.exact_groups(frame(spark, ROWS), digest).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted((x[:3] for x in plain_groups(ROWS)), key=key)
    assert sum(r.kept for r in got) == len({x[3] for x in plain_groups(ROWS)})


def test_ledger_goes_on_and_keep_first(spark):
    docs = frame(spark, ROWS)
    seen = docs.select(exact_dedup.sha256(exact_dedup.normalised(F.col("text"))).alias("digest"), "doc_id", F.monotonically_increasing_id().alias("locator"))
    ledger = exact_dedup.Ledger(spark)
    ledger.ingest(seen.filter("doc_id <= 3"))
    ledger.ingest(seen.filter("doc_id > 3 or doc_id is null"))
    whole = {bytes(r.digest): (r.keep.doc_id, r.size) for r in ledger.entries().collect()}
    assert whole == {bytes.fromhex(h): (k, n) for _, k, n, h in plain_groups(ROWS)}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "5", "6", "None"]
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


LONG = "x" * 200_000


def test_secrets_versions_and_edges(spark):
    rows = [(1, 'api_key="abcdef123" token: abc', "s"), (2, "AKIA" + "Q" * 16 + " " + "0123456789abcdef" * 2, "s"), (1, 'api_key="abcdef123" token: abc', "s"), (3, None, "s"), (None, "SECRET=pass/word+1 ghp_" + "a" * 36, "s"), (7, LONG + " é😀 passwd=1234567", "s"), (8, "secret=token: abcdefgh", "s")]
    docs, ledger = frame(spark, rows), secret_scan.BlobLedger(spark)
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base, r.spans) for r in secret_scan.scan(docs, ledger).collect())

    def plain(t):
        t, out = t or "", []
        rx = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(rx, t, re.I) if len(m[1]) >= 6]
        out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return out, [(m.start(), 4, "github", m.end()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]{36,255}", t)]

    text = lambda s: ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(s))
    want = []
    for i, t, _ in rows:
        base, more = plain(t)
        want.append((str(i), *(sum(s[2] == k for s in base) for k in ("assign", "access", "hex")), text(base), text(base + more)))
    assert got == sorted(want)
    before = ledger.findings(secret_scan.RULE_VERSION).count()
    assert before == len({t or "" for _, t, _ in rows})
    secret_scan.scan(docs, ledger)  # nothing is unseen
    assert ledger.findings(secret_scan.RULE_VERSION).count() == before
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_personal_data(spark):
    rows = [
        (1, "mail a.b@c.de_x@d.ee.f. or a@b", "s"), (2, "ip 1.2.3.4.5 256.1.1.1 0001.2.3.004", "s"), (3, "card 4111 1111-1111 1111 and 4111111111111112", "s"),
        (4, "call +1 (555) 123-4567 or +49 30", "s"), (None, None, "s"), (6, "iban GB82WEST12345698765432, ssn 123-45-6789", "s"), (7, "123-45-6789", "s"), (8, "9" * 100_000 + " a" * 1000 + "@x.yy", "s"), (8, "é😀 x@y.zz", "s"), (8, "é😀 x@y.zz", "s"),
    ]
    found = [(str(r.doc_id), r.base, r.spans, r.n_iban, r.n_ssn) for r in pii.find(frame(spark, rows)).collect()]

    def luhn(d):
        return sum((2 * x - 9 * (x > 4)) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def plain(t):
        t, out = t or "", []
        num = lambda m: re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 0, "email", m.end()) for m in re.finditer(pii.EMAIL, t)]
        out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(pii.IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, "card", m.end()) for m in re.finditer(pii.CARD, t) if 14 <= len(num(m)) <= 19 and luhn(num(m))]
        out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(pii.PHONE, t) if 10 <= len(num(m)) <= 15]
        return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(out))

    assert sorted((i, b) for i, b, *_ in found) == sorted((str(i), plain(t)) for i, t, _ in rows)
    extra = {i: (n, s) for i, _, _, n, s in found}
    assert extra["6"] == (1, 1) and extra["7"] == (0, 0)
    assert pii.find(frame(spark, rows).limit(0)).count() == 0


def test_mixing(spark):
    rows = [(k, "w " * (k % 7 + 1), "abc"[k % 3] if k % 11 else None) for k in range(300)] + [(5, "w w w w w w", "c")] * 3 + [(None, None, "a"), (999, "", "zz")]
    docs = frame(spark, rows)
    got = mixing.takes(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(v) == int(t) for (_, t), v in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.takes(docs).collect()))
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.takes(docs.limit(0)).count() == 0


def test_two_ingests_compare_texts(spark):
    """A weak digest under which all texts meet: later ingests compare with the text that an earlier one left."""
    same = lambda t: F.lit("00").cast("binary")
    ledger = exact_dedup.Ledger(spark)
    first = exact_dedup.exact_groups(frame(spark, [(9, "alpha", "a"), (2, "Alpha", "a")]), same, ledger).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first} == {(9, 9, 2, True), (2, 9, 2, False)}
    second = exact_dedup.exact_groups(frame(spark, [(1, "beta", "a"), (3, "ALPHA", "a"), (9, "alpha", "a")]), same, ledger).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in second} == {(1, 1, 1, True), (3, 9, 4, False), (9, 9, 4, False)}
    third = exact_dedup.exact_groups(frame(spark, [(5, "Beta", "a"), (4, "gamma", "a"), (4, "gamma", "a")]), same, ledger).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in third) == [(4, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True)]
    assert exact_dedup.exact_groups(frame(spark, []), same, ledger).count() == 0


def test_exact_dedup_of_repeated_null_ids_and_long_texts(spark):
    rows = [(None, "copy", "a")] * 50 + [(None, "Copy", "b"), (7, "y" * 300_000, "a"), (8, "Y" * 300_000, "a")]
    got = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got if r.doc_id is None} == {51}
    kept = exact_dedup.keep_first(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["8", "None"]
