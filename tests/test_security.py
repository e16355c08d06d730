"""Personal data, compliance rules, audit chains and encryption."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from metricloom.functions import crypto, pii
from metricloom.operators import audit as U
from metricloom.operators import compliance as C
from metricloom.sources import audit_log

TEXTS = [
    "mail jo.doe+x@mail.example.co and 10.0.0.1, call +1 (555) 123-4567 or 555.123.4567",
    "card 4111-1111-1111-1111 or 4111 1111 1111 1111; ssn 123-45-6789 and 123456789",
    "none here: 12-34, a@b, 1.2.3",
    "",
]


def test_hits_match_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = rows_of(C.scan_text(df, ["i"]).select("i", "pii_type"))
    want = sorted(
        ((i, kind) for i, t in enumerate(TEXTS) for kind, p in pii.PATTERNS.items() for _ in re.findall(p, t)),
        key=lambda t: tuple(str(x) for x in t),
    )
    assert got == want and len(got) > 5


def test_previews(spark):
    rows = [
        ("email", "jo.doe@mail.org", "jo***@mail.org"),
        ("email", "a@b@c.org", "***"),
        ("credit_card", "4111-1111-1111-1111", "****-****-****-1111"),
        ("ssn", "123-45-6789", "***-**-6789"),
        ("phone", "555-123-4567", "55********67"),
        ("ip_address", "10.0.0.1", "10****.1"),
        ("phone", "1234", "****"),
    ]
    df = spark.createDataFrame(rows, "kind string, value string, want string")
    for r in df.select("want", pii.preview(F.col("kind"), F.col("value")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_nested_json_paths(spark):
    doc = {
        "a": {"b": [1, "x@y.org", {"c": "10.0.0.1", "d": {"e": ["1.1.1.1"]}}], "n": None},
        "skip": [["u@v.org"]],
        "top": "p@q.org",
    }
    df = spark.createDataFrame([("r", json.dumps(doc)), ("bad", "{"), ("null", None)], "id string, config string")
    got = rows_of(C.scan_json(df, ["id"]).select("location", "pii_type"))
    assert got == [
        ("a.b[1]", "email"), ("a.b[2].c", "ip_address"), ("a.b[2].d.e[0]", "ip_address"), ("top", "email"),
    ]


def rules(spark, config, standards=C.STANDARDS):
    df = spark.createDataFrame([("x", json.dumps(config))], "id string, config string")
    return sorted(r["rule_id"] for r in C.check_configs(df, standards).collect())


def test_config_rules(spark):
    good = {"encryption_enabled": True, "encryption_algorithm": "AES-256-GCM", "audit_enabled": True}
    assert rules(spark, good) == []
    assert rules(spark, {}) == ["HIPAA-AUD-001", "HIPAA-ENC-001", "SOC2-CC6.1", "SOC2-CC7.2"]
    assert rules(spark, {}, ["gdpr"]) == []
    assert rules(spark, {**good, "encryption_algorithm": "3DES"}, []) == ["SOC2-CC6.7"]
    assert rules(spark, {**good, "audit_retention_days": 89}) == ["HIPAA-AUD-002"]
    assert rules(spark, {**good, "audit_retention_days": 90}) == []
    assert rules(spark, {**good, "data_retention_days": 1096}) == ["GDPR-RET-001"]
    assert rules(spark, {**good, "data_retention_days": 1095}) == []
    assert rules(spark, {**good, "Patient_Id": 1, "deep": {"health": 1}}) == ["HIPAA-PHI-001"]
    assert rules(spark, {**good, "note": "jo@mail.org"}, []) == ["GDPR-PII-001"]


def test_report(spark):
    df = spark.createDataFrame(
        [("bad", "{}"), ("good", '{"encryption_enabled":true,"audit_enabled":true}')], "id string, config string"
    )
    found = C.check_configs(df, ["hipaa", "soc2"])
    lines = C.report_lines(df, found, ["hipaa", "soc2"]).orderBy("id", "section", "item").collect()
    bad = "\n".join(r["line"] for r in lines if r["id"] == "bad")
    assert "## Status: 4 VIOLATIONS FOUND" in bad
    assert bad.index("### CRITICAL (2)") < bad.index("### HIGH (1)") < bad.index("### MEDIUM (1)")
    assert "- **HIPAA-ENC-001**: Encryption at rest is required for PHI\n  - Location: `encryption`" in bad
    good = [r["line"] for r in lines if r["id"] == "good"]
    assert len(good) == 1 and "COMPLIANT" in good[0]
    status = {r["id"]: r["compliant"] for r in C.compliance_status(df, found).collect()}
    assert status == {"bad": False, "good": True}


# -- audit -------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark):
    rows = [
        (log, i, f"{log}{i}", f"2024-01-01T00:00:{i:02}", "run.create" if i % 2 else "error", "info", "me", "run", "1", "{}")
        for log in "ab"
        for i in range(25)
    ]
    events = spark.createDataFrame(
        rows,
        "log string, line_no long, id string, timestamp string, action string, severity string, actor string,"
        "resource_type string, resource_id string, details string",
    ).repartition(4)
    return U.build_chain(events, segment_lines=10).checkpoint()


def test_chain_matches_hashlib(chain):
    rows = sorted(chain.collect(), key=lambda r: (r["log"], r["line_no"]))
    previous = None
    for r in rows:
        if r["line_no"] % 10 == 0:
            previous = None
        text = "\x1f".join([*[r[c] for c in U.HASHED], previous or ""])
        assert r["previous_hash"] == previous and r["segment"] == r["line_no"] // 10
        assert r["event_hash"] == hashlib.sha256(text.encode()).hexdigest()
        previous = r["event_hash"]


def test_clean_chain_verifies(chain):
    assert U.verify_chain(chain).count() == 0
    summary = U.verify_summary(chain, U.verify_chain(chain)).collect()
    assert all(r["valid"] and r["lines"] == 25 for r in summary)
    assert U.verify_chain(chain, hot_rows=3).count() == 0


def errors(df):
    return rows_of(U.verify_chain(df).select("log", "line_no", "error"))


def test_tampering(chain):
    link, content = "Previous hash mismatch", "Event hash mismatch (tampering detected)"
    at = (F.col("log") == "a") & (F.col("line_no") == 4)
    edited = chain.withColumn("actor", F.when(at, "you").otherwise(F.col("actor")))
    assert errors(edited) == [("a", 4, content)]
    assert errors(chain.where(~at)) == [("a", 5, content), ("a", 5, link)]
    severity = chain.withColumn("severity", F.lit("debug"))  # not part of the hash
    assert errors(severity) == []
    unreadable = chain.withColumn("parse_error", F.when(at, "bad line"))
    assert errors(unreadable) == [("a", 4, "Parse error - bad line"), ("a", 5, content), ("a", 5, link)]
    removed_start = chain.where("line_no <> 10")
    assert {e[1] for e in errors(removed_start)} == {11}


def test_links_between_segments(chain):
    links = U.link_segments(chain, fan_out=2).collect()
    level0 = {(r["log"], r["unit"]): r["link"] for r in links if r["level"] == 0}
    heads = {(r["log"], r["segment"]): r["head"] for r in U.segment_heads(chain).collect()}
    one = hashlib.sha256(("\x1f" + heads[("a", 0)]).encode()).hexdigest()
    two = hashlib.sha256((one + "\x1f" + heads[("a", 1)]).encode()).hexdigest()
    assert level0[("a", 0)] == one and level0[("a", 1)] == two
    assert {r["level"] for r in links} == {0, 1}


def test_log_files(spark, chain, tmp_path):
    path = str(tmp_path / "audit")
    audit_log.write_log(chain, path)
    parsed = audit_log.parse_lines(audit_log.read_lines(spark, path))
    assert parsed.count() == 50 and U.verify_chain(parsed).count() == 0
    bad = spark.createDataFrame([("{oops", "a", 0, 99)], "value string, log string, segment long, line_no long")
    broken = audit_log.parse_lines(bad)
    assert broken.first()["parse_error"] == "malformed JSON" and broken.first()["line_no"] == 99
    assert audit_log.good_events(parsed.unionByName(broken)).count() == 50
    hits = U.query_events(audit_log.good_events(parsed), action="error", start="2024-01-01 00:00:02", end="2024-01-01 00:00:06")
    assert [(r["log"], r["line_no"]) for r in hits.collect()] == [(g, i) for g in "ab" for i in (2, 4, 6)]
    assert U.query_events(parsed, limit=7).count() == 7


def test_statistics(chain):
    rows = {(r["dimension"], r["key"]): r["events"] for r in U.audit_statistics(chain).collect()}
    assert rows == {
        ("total", ""): 50, ("action", "error"): 26, ("action", "run.create"): 24, ("severity", "info"): 50,
    }


# -- encryption --------------------------------------------------------------


def test_round_trip_and_rotation(spark):
    keys = crypto.key_table(spark, {"k1": crypto.derive_key("pw", b"s" * 16), "k2": b"x" * 32})
    df = spark.createDataFrame([(1, "hello", "k1"), (2, None, "k2")], "i int, text string, key_id string")
    sealed = crypto.encrypt_columns(df, ["text"], keys).checkpoint()
    row = sealed.where("i = 1").first()
    assert len(row["text"]) == 5 + 28
    assert "_key" not in sealed.columns
    opened = crypto.decrypt_columns(sealed, ["text"], keys).select("i", F.col("text").cast("string"))
    assert rows_of(opened) == [(1, "hello"), (2, None)]
    rotated = crypto.rotate_keys(sealed, ["text"], keys, F.lit("k2")).checkpoint()
    assert rows_of(crypto.decrypt_columns(rotated, ["text"], keys).select(F.col("text").cast("string"), "key_id")) == [
        (None, "k2"), ("hello", "k2"),
    ]
    assert crypto.derive_key("pw", b"s" * 16) == hashlib.pbkdf2_hmac("sha256", b"pw", b"s" * 16, 100_000, 32)
    prints = {r["key_id"]: r["fingerprint"] for r in crypto.fingerprints(keys).collect()}
    assert prints["k2"] == hashlib.sha256(b"x" * 32).hexdigest()[:16]


def test_unknown_key_stops(spark):
    keys = crypto.key_table(spark, {"k1": b"x" * 32})
    df = spark.createDataFrame([("a", "gone")], "text string, key_id string")
    with pytest.raises(Exception, match="no key with id gone"):
        crypto.encrypt_columns(df, ["text"], keys).collect()


def test_keys_stay_out_of_plans(spark):
    key = b"0123456789abcdef0123456789abcdef"
    keys = crypto.key_table(spark, {"k1": key})
    df = spark.createDataFrame([("a", "k1")], "text string, key_id string")
    plan = crypto.encrypt_columns(df, ["text"], keys)._jdf.queryExecution().toString()
    assert key.decode() not in plan and key.hex() not in plan


def test_unreadable_configurations_are_findings(spark):
    deep = '{"a":' * 3000 + '"x@y.example.org"' + "}" * 3000
    rows = [
        ("cut", '{"mail": "jo@example.org"'), ("list", '["10.0.0.1"]'), ("text", "oops"), ("deep", deep),
        ("empty", ""), ("null", None), ("good", '{"mail": "jo@example.org"}'), ("none", "{}"),
    ]
    configs = spark.createDataFrame(rows, "id string, config string")
    got = rows_of(C.check_contents(configs, ["gdpr"]).select("id", "rule_id", "location"))
    unread = [r for r in got if r[1] == C.UNREADABLE_RULE]
    assert {r[0] for r in unread} >= {"cut", "list", "text"} and not {r[0] for r in unread} & {"empty", "null", "good", "none"}
    hits = {(r[0], r[2]) for r in got if r[1] == "GDPR-PII-001"}
    assert {("cut", pii.UNREADABLE), ("list", pii.UNREADABLE), ("good", "mail")} <= hits
    assert [p for i, p in hits if i == "deep"]  # found, whether or not the parser goes so deep
    status = {r["id"]: r["compliant"] for r in C.compliance_status(configs, C.check_configs(configs, ["gdpr"])).collect()}
    assert not status["text"] and not status["cut"] and status["none"]


def test_json_walk_is_bounded():
    """Strings leave a worker in pieces of bounded size, however large the batch of documents, and none is lost."""
    many = ["{" + ", ".join(f'"k{i}": "v{i}"' for i in range(25_000)) + "}"]
    docs = [json.dumps({"a": [{"b": "x" * 500_000}], "n": 1}) for _ in range(40)] + many + ["broken", "[1]"]
    batch = pa.RecordBatch.from_pydict({"id": [f"d{i}" for i in range(len(docs))], "config": docs})
    pieces = list(pii.string_pieces(iter([batch])))
    assert max(p.num_rows for p in pieces) <= pii.PIECE_ROWS
    assert max(p.nbytes for p in pieces) < pii.PIECE_CHARS + 1_000_000
    got = pa.Table.from_batches(pieces)
    assert got.column_names == ["id", "location", "text"]
    rows = list(zip(*(got[c].to_pylist() for c in got.column_names)))
    assert rows[:40] == [(f"d{i}", "a[0].b", "x" * 500_000) for i in range(40)]
    assert rows[40:-2] == [("d40", f"k{i}", f"v{i}") for i in range(25_000)]
    assert rows[-2:] == [("d41", pii.UNREADABLE, "broken"), ("d42", pii.UNREADABLE, "[1]")]


def test_configurations_make_no_list_of_strings_a_row(spark):
    """No value of a batch's size: the JSON walk gives rows, not an array column of a scalar function."""
    configs = spark.createDataFrame([("1", '{"a": "mail me@example.org"}')], "id string, config string")
    for found in (C.check_configs(configs), C.compliance_status(configs, C.check_configs(configs))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_documents_without_a_hit_need_no_parser(spark):
    """Numbers of settings are no hits, so such documents never reach a Python worker."""
    docs = ['{"data_retention_days": 2000, "Patient_age": 12345, "note": "in 2024, v1.25"}', '{"a": "12-3456 or 1234, 5678"}', "{}"]
    docs += ['{"a": "jo@mail.org"}', '{"a": "12 3456"}', '{"a": "10.0.0.1"}', '{"a": "\\u0034111"}', None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, config string")
    assert [r["id"] for r in df.where(pii.may_hit(F.col("config"))).orderBy("id").collect()] == [1, 3, 4, 5, 6]


def test_every_hit_passes_the_filter(spark):
    """Whatever the document, what the walk would find without the filter is found with it."""
    draw = random.Random(7)
    kinds = ["+1 (555) 123-4567", "5551234567", "123-45-6789", "123456789", "4111 1111 1111 1111", "10.0.0.1", "a@b.org"]
    marks = ["", "", *" .-\n\t\f\r\b\x0b/", '"', "\\", "\\n", "n", "7", "\u00e9"]
    rows = []
    for i in range(1500):
        value = re.sub("[-. ]", lambda m: m[0] if draw.random() < 0.4 else draw.choice(marks), draw.choice(kinds))
        text = draw.choice(marks) + value + draw.choice(marks) + draw.choice(kinds)[: draw.randrange(12)]
        document = json.dumps({"k": [{"n": text}]}, ensure_ascii=draw.random() < 0.5)
        rows.append((str(i), draw.choice([document, document, document[:-2], text, json.dumps([text])])))
    df = spark.createDataFrame(rows, "id string, config string")
    whole = C.scan_text(pii.json_strings(df, ["id"], "config"), ["id", "location"])
    want = rows_of(whole)
    assert rows_of(C.scan_json(df, ["id"])) == want and len(want) > 500
