"""Personal data, compliance, audit and encryption queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import crypto, pii
from metricloom.operators import audit as U
from metricloom.operators import compliance as C
from metricloom.operators import seals as S
from metricloom.plans.common import Registry, tables, with_tables
from metricloom.session import ensure_checkpoint_dir, new_work_folder
from metricloom.sources import audit_log, line_source

REGISTRY = Registry()
query = REGISTRY.query

# -- personal data -----------------------------------------------------------


def _texts(spark, folder) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select(
        F.concat(F.lit("document/"), "doc_id").alias("place"), "text"
    )
    talks = tables.table(spark, folder, "conversations").select(
        F.concat(F.lit("conversation/"), "conv_id", F.lit("/"), "turn").alias("place"), "text"
    )
    pages = tables.table(spark, folder, "pages").select(
        F.concat(F.lit("page/"), "page_id").alias("place"), F.col("html").alias("text")
    )
    return docs.unionByName(talks).unionByName(pages)


_TEXTS = """texts AS (SELECT 'document/' || doc_id AS place, text FROM documents
    UNION ALL SELECT 'conversation/' || conv_id || '/' || turn, text FROM conversations
    UNION ALL SELECT 'page/' || page_id, html FROM pages)"""
_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT {{ids}}, '{kind}' AS pii_type, unnest(regexp_extract_all(text, '{pattern}')) AS v FROM {{source}}"
    for kind, pattern in pii.PATTERNS.items()
) + ")"
_PREVIEW = """CASE WHEN length(v) <= 4 THEN '****'
    WHEN pii_type = 'email' THEN CASE WHEN len(string_split(v, '@')) = 2
        THEN substr(string_split(v, '@')[1], 1, 2) || '***@' || string_split(v, '@')[2] ELSE '***' END
    WHEN pii_type = 'credit_card' THEN '****-****-****-' || right(v, 4)
    WHEN pii_type = 'ssn' THEN '***-**-' || right(v, 4)
    ELSE left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) END"""


def _hits(ids: str, source: str) -> str:
    return _HITS.replace("{ids}", ids).replace("{source}", source)


@query(
    f"""WITH {_TEXTS}, {_hits("place", "texts")}
    SELECT split_part(place, '/', 1) AS kind, pii_type, count(*) AS hits FROM hits GROUP BY ALL"""
)
def pii_scan(spark, folder):
    hits = C.scan_text(_texts(spark, folder), ["place"])
    kind = F.element_at(F.split("place", "/"), 1)
    return C.scan_counts(hits.withColumn("kind", kind), ["kind"])


@query(
    f"""WITH {_TEXTS}, {_hits("place", "texts")}
    SELECT place, pii_type, {_PREVIEW} AS value_preview FROM hits"""
)
def pii_redact(spark, folder):
    return C.scan_text(_texts(spark, folder), ["place"]).select("place", "pii_type", "value_preview")


# -- compliance --------------------------------------------------------------


def _configs(spark, folder) -> DataFrame:
    """A nested configuration per document; settings follow from its labels and length."""
    docs = tables.table(spark, folder, "documents")
    labels = tables.table(spark, folder, "labels")
    q, n = F.col("quality"), F.col("n_chars")
    config = F.to_json(
        F.struct(
            F.struct(F.array(F.struct(F.col("text").alias("note"))).alias("items")).alias("data"),
            F.when(q == 1, n).alias("Patient_age"),
            F.coalesce(q == 1, F.lit(False)).alias("encryption_enabled"),
            F.when(F.col("toxic") == 1, "3DES").otherwise("AES-256-GCM").alias("encryption_algorithm"),
            q.isNotNull().alias("audit_enabled"),
            F.when(n < 2000, 30).otherwise(400).alias("audit_retention_days"),
            F.when(n > 5000, 2000).otherwise(300).alias("data_retention_days"),
        )
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), config.alias("config")
    )


_VIOLATIONS = f"""cfg AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, text, n_chars AS n, quality = 1 AS enc,
        toxic = 1 AS weak, quality IS NOT NULL AS aud FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    {_hits("id", "cfg")},
    vio AS (
        SELECT id, 'GDPR-PII-001' AS rule_id, 'high' AS severity, 'data.items[0].note' AS location,
            'PII detected in configuration: ' || pii_type AS description FROM hits
        UNION ALL SELECT id, 'HIPAA-PHI-001', 'high', 'Patient_age', 'Potential PHI field name: Patient_age' FROM cfg WHERE enc
        UNION ALL SELECT id, 'SOC2-CC6.7', 'high', 'encryption_algorithm', 'Weak encryption algorithm: 3DES' FROM cfg WHERE enc AND weak
        UNION ALL SELECT id, 'HIPAA-ENC-001', 'critical', 'encryption', 'Encryption at rest is required for PHI' FROM cfg WHERE NOT coalesce(enc, false)
        UNION ALL SELECT id, 'SOC2-CC6.1', 'medium', 'encryption', 'Data encryption is recommended' FROM cfg WHERE NOT coalesce(enc, false)
        UNION ALL SELECT id, 'HIPAA-AUD-001', 'critical', 'audit_logging', 'Audit controls required for PHI access' FROM cfg WHERE NOT aud
        UNION ALL SELECT id, 'SOC2-CC7.2', 'high', 'audit_logging', 'Audit logging is required' FROM cfg WHERE NOT aud
        UNION ALL SELECT id, 'HIPAA-AUD-002', 'high', 'audit_log_retention', 'Audit log retention (30 days) below minimum' FROM cfg WHERE aud AND n < 2000
        UNION ALL SELECT id, 'GDPR-RET-001', 'medium', 'data_retention_days', 'Data retention (2000 days) may exceed necessity' FROM cfg WHERE n > 5000)"""


@query(f"WITH {_VIOLATIONS} SELECT id, rule_id, severity, location, description FROM vio")
def config_compliance(spark, folder):
    rows = C.check_configs(_configs(spark, folder))
    return rows.select("id", "rule_id", "severity", "location", "description")


@query(
    f"""WITH {_VIOLATIONS} SELECT cfg.id, count(rule_id) AS violations, count(rule_id) = 0 AS compliant
    FROM cfg LEFT JOIN vio ON cfg.id = vio.id GROUP BY cfg.id"""
)
def compliance_status(spark, folder):
    configs = _configs(spark, folder)
    return C.compliance_status(configs, C.check_configs(configs))


_REMEDIES = " ".join(f"WHEN '{rule}' THEN '{texts[4]}'" for rule, texts in C.RULES.items())


@query(
    f"""WITH {_VIOLATIONS}, s AS (SELECT id, severity, count(*) AS c FROM vio GROUP BY ALL)
    SELECT id, list_position(['critical', 'high', 'medium', 'low'], severity)::BIGINT AS section,
        '### ' || upper(severity) || ' (' || c || ')' AS title FROM s
    UNION ALL SELECT id, list_position(['critical', 'high', 'medium', 'low'], severity)::BIGINT,
        '- **' || rule_id || '**: ' || description || chr(10) || '  - Location: `' || location || '`' || chr(10)
        || '  - Remediation: ' || CASE rule_id {_REMEDIES} END FROM vio
    UNION ALL SELECT cfg.id, 0, '# Compliance Report' || chr(10) || chr(10) || 'Standards Checked: {", ".join(C.STANDARDS)}'
        || chr(10) || chr(10) || CASE WHEN count(rule_id) = 0
            THEN '## Status: COMPLIANT' || chr(10) || 'No violations detected.'
            ELSE '## Status: ' || count(rule_id) || ' VIOLATIONS FOUND' || chr(10) END
        FROM cfg LEFT JOIN vio ON cfg.id = vio.id GROUP BY cfg.id"""
)
def compliance_report(spark, folder):
    ensure_checkpoint_dir(spark)
    configs = _configs(spark, folder)
    # The report reads the violations three times; the scan behind them runs once.
    lines = C.report_lines(configs, C.check_configs(configs).checkpoint())
    return lines.select("id", "section", F.col("line").alias("title"))


# -- audit -------------------------------------------------------------------

SEGMENT = 100


@query(
    with_tables(
        "audit",
        body="""SELECT log, line_no, actor, stamp FROM audit WHERE action = 'error'
        AND stamp >= '2024-01-02T00:00:00' AND stamp <= '2024-01-20T00:00:00.000000'
        ORDER BY log, line_no LIMIT 100""",
    )
)
def audit_query(spark, folder):
    rows = U.query_events(
        tables.audit_events(spark, folder),
        action="error",
        resource_type="run",
        start="2024-01-02 00:00:00",
        end="2024-01-20 00:00:00",
    )
    return rows.select("log", "line_no", "actor", F.col("timestamp").alias("stamp"))


@query(
    with_tables(
        "audit",
        body="""SELECT 'total' AS dimension, '' AS key, count(*) AS events FROM audit
        UNION ALL SELECT 'action', action, count(*) FROM audit GROUP BY action
        UNION ALL SELECT 'severity', severity, count(*) FROM audit GROUP BY severity""",
    )
)
def audit_stats(spark, folder):
    return U.audit_statistics(tables.audit_events(spark, folder))


def chain_sql(segment: str, numbered: str) -> str:
    """Chain by recursion: each round links one more line of every segment."""
    return f"""num AS ({numbered}),
    pos AS (SELECT *, {segment} AS segment FROM num),
    seq AS (SELECT *, row_number() OVER (PARTITION BY log, segment ORDER BY line_no) AS k FROM pos),
    chain AS (
        SELECT log, segment, line_no, k, CAST(NULL AS VARCHAR) AS previous_hash,
            sha256(concat_ws(chr(31), id, stamp, action, actor, resource_type, resource_id, details, '')) AS event_hash
        FROM seq WHERE k = 1
        UNION ALL
        SELECT s.log, s.segment, s.line_no, s.k, c.event_hash,
            sha256(concat_ws(chr(31), s.id, s.stamp, s.action, s.actor, s.resource_type, s.resource_id, s.details, c.event_hash))
        FROM chain c JOIN seq s ON s.log = c.log AND s.segment = c.segment AND s.k = c.k + 1)"""


_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY log ORDER BY line_no) - 1 AS idx FROM audit"


def _recursive(*names: str, body: str) -> str:
    return with_tables(*names, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _recursive(
        "audit",
        body=f"""+ {chain_sql(f"CAST(idx // {SEGMENT} AS BIGINT)", _NUMBERED)}
        SELECT log, segment, line_no, coalesce(previous_hash, '') AS previous_hash, event_hash FROM chain""",
    )
)
def audit_chain_build(spark, folder):
    chain = U.build_chain(tables.audit_events(spark, folder), SEGMENT)
    return chain.select(
        "log",
        "segment",
        "line_no",
        F.coalesce("previous_hash", F.lit("")).alias("previous_hash"),
        "event_hash",
    )


@query(
    with_tables(
        "audit",
        body="""+ x AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY line_no) - 1 AS idx FROM audit)
        SELECT log, line_no, 'Event hash mismatch (tampering detected)' AS error FROM x
            WHERE value > 200 AND value <= 250
        UNION ALL SELECT log, line_no, 'Parse error - malformed JSON' FROM x WHERE value > 250
        UNION ALL SELECT log, line_no, unnest(['Previous hash mismatch', 'Event hash mismatch (tampering detected)'])
            FROM (SELECT *, lag(value) OVER (PARTITION BY log, idx // 100 ORDER BY line_no) AS before FROM x)
            WHERE before > 250 AND value <= 200
        UNION ALL SELECT log, line_no, 'Previous hash mismatch'
            FROM (SELECT *, lag(value) OVER (PARTITION BY log, idx // 100 ORDER BY line_no) AS before FROM x)
            WHERE before > 250 AND value > 200 AND value <= 250""",
    )
)
def audit_chain_verify(spark, folder):
    """A chain in which large events were edited and the largest made unreadable."""
    events = tables.audit_events(spark, folder)
    sizes = tables.table(spark, folder, "events").select(
        F.col("event_id").alias("line_no"), F.col("value").alias("_size")
    )
    ensure_checkpoint_dir(spark)
    # Stands for a stored log, which a check reads rather than builds.
    chain = U.build_chain(events, SEGMENT).join(sizes, "line_no").checkpoint()
    size = F.col("_size")
    lines = chain.withColumns(
        {
            "details": F.when((size > 200) & (size <= 250), "{}").otherwise(F.col("details")),
            "parse_error": F.when(size > 250, "malformed JSON"),
        }
    )
    return U.verify_chain(lines).select("log", "line_no", "error")


@query(
    _recursive(
        "audit",
        body=f"""+ {chain_sql(f"CAST(idx // {SEGMENT} AS BIGINT)", _NUMBERED)},
        heads AS (SELECT log, segment, arg_max(event_hash, line_no) AS head, count(*) AS lines
            FROM chain GROUP BY log, segment)
        SELECT * FROM heads""",
    )
)
def audit_segment_heads(spark, folder):
    return U.segment_heads(U.build_chain(tables.audit_events(spark, folder), SEGMENT))


# -- sealed segments -----------------------------------------------------------

_LEAVES = f"""+ {chain_sql(f"CAST(idx // {SEGMENT} AS BIGINT)", _NUMBERED)},
    leaves AS (SELECT log, segment, arg_max(event_hash, line_no) AS head, count(*) AS lines
        FROM chain GROUP BY log, segment)"""


def tree_sql(leaves: str, prefix: str) -> str:
    """The levels of the hash tree as CTEs ``{prefix}0`` (leaves) to ``{prefix}{DEPTH}`` (roots)."""
    parts = [
        f"""{prefix}0 AS (SELECT log, segment AS unit,
            sha256(concat_ws(chr(31), 'leaf', segment, head, lines)) AS hash FROM {leaves})"""
    ]
    for level in range(1, S.DEPTH + 1):
        parts.append(
            f"""{prefix}{level} AS (SELECT log, unit // {S.FAN_OUT} AS unit, sha256(concat_ws(chr(31), 'node {level}',
            unit // {S.FAN_OUT}, string_agg(unit || ':' || hash, chr(31) ORDER BY unit))) AS hash
            FROM {prefix}{level - 1} GROUP BY log, unit // {S.FAN_OUT})"""
        )
    return ", ".join(parts)


@query(
    _recursive(
        "audit",
        body=f"""{_LEAVES}, {tree_sql("leaves", "t")}
        SELECT log, segments, lines, hash AS root FROM t{S.DEPTH}
        JOIN (SELECT log, count(*) AS segments, sum(lines)::BIGINT AS lines FROM leaves GROUP BY log) USING (log)""",
    )
)
def audit_segment_links(spark, folder):
    """The sealed root of every log."""
    return S.roots(S.seal_leaves(U.build_chain(tables.audit_events(spark, folder), SEGMENT)))


def _sealed(spark, folder) -> tuple[DataFrame, DataFrame]:
    """A stored chain and its leaves, as they would lie in storage."""
    ensure_checkpoint_dir(spark)
    chain = U.build_chain(tables.audit_events(spark, folder), SEGMENT).checkpoint()
    return chain, S.seal_leaves(chain).checkpoint()


def _day_of_month() -> Column:
    return F.right("log", F.lit(2)).cast("int")


@query(
    _recursive(
        "audit",
        body=f"""{_LEAVES},
        s AS (SELECT l.*, day(CAST(log AS DATE)) AS d, max(segment) OVER (PARTITION BY log) AS last FROM leaves l)
        SELECT log, segment, 'Segment missing' AS error FROM s WHERE d % 5 = 0 AND segment % 3 = 1
        UNION ALL SELECT log, segment, unnest(['Line count differs from seal', 'Segment head differs from seal'])
            FROM s WHERE d % 5 = 1 AND segment = last AND lines > 1
        UNION ALL SELECT log, segment, 'Segment missing' FROM s WHERE d % 5 = 1 AND segment = last AND lines = 1
        UNION ALL SELECT log, segment, 'Segment moved (sealed as ' || (1 - segment) || ')' FROM s
            WHERE d % 5 = 2 AND segment < 2 AND last > 0
        UNION ALL SELECT a.log, a.segment, 'Line count differs from seal' FROM s a JOIN s b
            ON a.log = b.log AND a.segment < 2 AND b.segment = 1 - a.segment WHERE a.d % 5 = 2 AND a.lines <> b.lines
        UNION ALL SELECT log, segment, 'Line count differs from seal' FROM s WHERE d % 5 = 3 AND segment = 0
        UNION ALL SELECT log, NULL, 'Seal does not match root' FROM s WHERE d % 5 = 3 AND segment = 0""",
    )
)
def audit_tamper_segments(spark, folder):
    """Sealed logs with segments taken out, a tail cut, two segments swapped, or the stored seal edited, by day."""
    chain, leaves = _sealed(spark, folder)
    kind = _day_of_month() % 5
    ends = chain.groupBy("log").agg(F.max("segment").alias("_last"), F.max("line_no").alias("_end"))
    swapped = (kind == 2) & (F.col("segment") < 2) & (F.col("_last") > 0)
    lines = (
        chain.join(ends, "log")
        .where(~((kind == 0) & (F.col("segment") % 3 == 1)) & ~((kind == 1) & (F.col("line_no") == F.col("_end"))))
        .withColumn("segment", F.when(swapped, 1 - F.col("segment")).otherwise(F.col("segment")))
    )
    edited = (kind == 3) & (F.col("segment") == 0)
    stored = leaves.withColumn("lines", F.when(edited, F.col("lines") - 1).otherwise(F.col("lines")))
    return S.verify_segments(lines, stored, S.roots(leaves))


@query(
    _recursive(
        "audit",
        body=f"""{_LEAVES}
        SELECT log, segment, segment % 4 <> 3 AS member FROM leaves
        UNION ALL SELECT log, max(segment) + 1, false FROM leaves GROUP BY log""",
    )
)
def audit_segment_members(spark, folder):
    """Every segment claimed with its path, each fourth with a wrong line count, and one more a log that never was."""
    _, leaves = _sealed(spark, folder)
    wrong = F.when(F.col("segment") % 4 == 3, F.col("lines") + 1).otherwise(F.col("lines"))
    claims = leaves.select("log", "segment", "head", wrong.alias("lines"))
    unknown = leaves.groupBy("log").agg(
        (F.max("segment") + 1).alias("segment"), F.max("head").alias("head"), F.lit(1).cast("long").alias("lines")
    )
    return S.verify_members(claims.unionByName(unknown), S.seal_nodes(leaves), S.roots(leaves))


LOG_LINES = 1000


@query(
    with_tables(
        "audit",
        body=f"""+ x AS (SELECT *, line_no // {LOG_LINES} AS segment,
            row_number() OVER (PARTITION BY log, line_no // {LOG_LINES} ORDER BY line_no) AS k FROM audit)
        SELECT log, segment, k AS file_line, CASE WHEN value > 250 THEN -1 ELSE line_no END AS line_no,
            CASE WHEN value > 250 THEN 'malformed JSON in line ' || k ELSE '' END AS parse_error,
            CASE WHEN value > 250 THEN '' ELSE action END AS action FROM x""",
    )
)
def audit_log_lines(spark, folder):
    """The log written as line files, the largest events cut in the middle, and every line read back."""
    sizes = tables.table(spark, folder, "events").select(
        F.col("event_id").alias("line_no"), F.col("value").alias("_size")
    )
    events = tables.audit_events(spark, folder).join(sizes, "line_no")
    fields = [c for c in events.columns if c not in ("log", "_size")]
    text = F.to_json(F.struct(*fields))
    cut = F.when(F.col("_size") > 250, F.left(text, F.lit(20))).otherwise(text)
    lines = events.select(
        cut.alias("value"), "log", F.floor(F.col("line_no") / LOG_LINES).alias("segment"), "line_no"
    )
    path = new_work_folder(spark, "audit-lines")
    (
        lines.repartition("log", "segment")
        .sortWithinPartitions("log", "segment", "line_no")
        .drop("line_no")
        .write.partitionBy("log", "segment")
        .option("compression", "gzip")
        .text(path)
    )
    parsed = audit_log.parse_lines(line_source.read_numbered(spark, path))
    return parsed.select(
        "log",
        "segment",
        "file_line",
        F.coalesce(F.when(F.col("parse_error").isNull(), F.col("line_no")), F.lit(-1)).alias("line_no"),
        F.coalesce("parse_error", F.lit("")).alias("parse_error"),
        F.when(F.col("parse_error").isNull(), F.col("action")).otherwise("").alias("action"),
    )


# -- encryption --------------------------------------------------------------


N_KEYS = 4


def _keys(spark) -> DataFrame:
    # Keys for a round trip, two generations of each; real ones come from a secret store.
    names = [f"k{i}/{n}" for i in range(N_KEYS) for n in (1, 2)]
    return crypto.key_table(
        spark, {k: crypto.derive_key(f"password {k}", b"salt-for-testing") for k in names}
    )


def _keyed(spark, folder) -> DataFrame:
    """Documents spread over the keys of the first generation."""
    slot = F.concat(F.lit("k"), F.pmod("doc_id", F.lit(N_KEYS)))
    docs = tables.table(spark, folder, "documents")
    return docs.withColumn("slot", slot).withColumn("key_id", F.concat("slot", F.lit("/1")))


@query("SELECT doc_id, text, 'k' || doc_id % 4 || '/1' AS key_id FROM documents")
def column_encrypt_roundtrip(spark, folder):
    docs = _keyed(spark, folder).select("doc_id", "text", "key_id")
    keys = _keys(spark)
    sealed = crypto.encrypt_columns(docs, ["text"], keys)
    opened = crypto.decrypt_columns(sealed, ["text"], keys)
    return opened.select("doc_id", F.col("text").cast("string").alias("text"), "key_id")


@query(
    """SELECT doc_id, octet_length(encode(text)) + 28 AS sealed_bytes, 'k' || doc_id % 4 || '/2' AS key_id, true AS same
    FROM documents"""
)
def column_key_rotation(spark, folder):
    docs = _keyed(spark, folder).select(
        "doc_id", "slot", F.col("text").alias("plain"), "text", "key_id"
    )
    keys = _keys(spark)
    sealed = crypto.encrypt_columns(docs, ["text"], keys)
    rotated = crypto.rotate_keys(sealed, ["text"], keys, F.concat("slot", F.lit("/2")))
    sized = rotated.withColumn("sealed_bytes", F.octet_length("text").cast("long"))
    opened = crypto.decrypt_columns(sized, ["text"], keys)
    same = F.col("text").cast("string") == F.col("plain")
    return opened.select("doc_id", "sealed_bytes", "key_id", same.alias("same"))
