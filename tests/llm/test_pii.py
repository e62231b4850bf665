import hashlib
import re

from pyspark.sql import functions as F

from helpers import ODD, documents
from marlstone.llm import pii

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, hit):
    number = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 9 <= len(number) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TRICKY = [
    "a@b.c_x@y.z a@b.c.d.e@f.g %+-@x-.y-. @a.b a@.b a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3 1..2.3.4 9999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 411111111111111111111111 4111 1111 1111 1111 2",
    "+1 (988) 555-2485 +12 +1---2 ++49 30 1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +3.4.5.6.7.8.9.1.2.",
    "é\U0001f600 x@y.z ñ 10.0.0.1 + +34 911 234 567 漢 4532015112830366",
    "a" * 20000 + "@" + "b." * 9000 + "c",
    "1" * 20000 + " " + "1-" * 9000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(TRICKY)) + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(documents(spark, rows))).collect()}
    for d, text in rows:
        want, r = plain(text), found[d]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(1 for x in want if x[0] == k) for k in PATTERNS], d
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), d
        assert r["spans"][: len(listed)] == listed


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00."), (2, "IBAN DE89 3704 0044 0532 0130 01."), (3, "the ssn: 123-45-6789"), (4, "part 123-45-6789"), (5, "ssn 000-45-6789")]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(documents(spark, rows))).collect()}
    assert "iban:5:32" in spans[1] and "iban" not in spans[2]
    assert spans[3] == "national_id:9:20" and spans[4] == "" and spans[5] == ""


def test_context_raises_the_score(spark):
    rows = [(1, "visa card 4111111111111111"), (2, "number 4111111111111111")]
    score = {r["doc_id"]: r["card"][0]["score"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert score[1] > score[2]


def test_redaction(spark):
    rows = [(1, "Mail é@x a@b.c or 10.0.0.1, end"), (2, None)]
    texts = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, rows)).collect()}
    assert texts == {1: "Mail é@x <email> or <ip>, end", 2: ""}


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("email", F.lit("x")).withColumn("ip", F.lit(1))
    found = pii.digest(pii.find_personal_data(docs)).collect()
    assert len(found) == len(ODD) and all(r["spans"] == "" and r["n_email"] == 0 for r in found)
    assert pii.find_personal_data(docs.limit(0)).collect() == []


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        found = spark.range(1).select(pii.running(F.transform(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, n), lambda x: x % 7))).first()[0]
        want, at = [], 0
        for x in range(1, n + 1):
            want.append(at)
            at += x % 7
        assert found == want


def test_a_log_full_of_addresses(spark):
    """One text of 200,000 lines with an address each is no quadratic work, and its offsets hold."""
    lines = [f"é{i} host 10.0.{i % 256}.{i // 256 % 256} ok" for i in range(200_000)]
    row = pii.find_personal_data(documents(spark, [(1, "\n".join(lines))])).select("ip").first()
    assert len(row["ip"]) == len(lines)
    at = 0
    for i, (line, span) in enumerate(zip(lines, row["ip"])):
        if i % 997 == 0:
            hit = line.split(" ")[2]
            assert (span["start"], span["end"]) == (at + line.index(hit), at + line.index(hit) + len(hit)) and span["score"] > 0.7
        at += len(line) + 1
