"""Personal data scans and configuration checks against compliance standards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import expressions as X
from metricloom.functions import pii

# Standards, key words and limits.
STANDARDS = ("gdpr", "hipaa", "soc2", "pci_dss")
PHI_KEYWORDS = ["patient", "diagnosis", "medical", "health", "ssn"]
WEAK_ALGORITHMS = ["des", "3des", "rc4", "md5"]
MAX_RETENTION_DAYS = 365 * 3
MIN_AUDIT_DAYS = 90
DEFAULT_AUDIT_DAYS = 90
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

# Rule -> (standard, severity, location, description, remediation).
RULES = {
    "GDPR-PII-001": (
        "gdpr",
        "high",
        None,
        "PII detected in configuration: %s",
        "Remove or anonymize PII before logging",
    ),
    "HIPAA-PHI-001": (
        "hipaa",
        "high",
        None,
        "Potential PHI field name: %s",
        "Ensure PHI is properly encrypted and access-controlled",
    ),
    "GDPR-RET-001": (
        "gdpr",
        "medium",
        "data_retention_days",
        "Data retention (%s days) may exceed necessity",
        "Review retention period for proportionality",
    ),
    "HIPAA-ENC-001": (
        "hipaa",
        "critical",
        "encryption",
        "Encryption at rest is required for PHI",
        "Enable AES-256 encryption",
    ),
    "SOC2-CC6.1": (
        "soc2",
        "medium",
        "encryption",
        "Data encryption is recommended",
        "Enable encryption for sensitive data",
    ),
    "SOC2-CC6.7": (
        "soc2",
        "high",
        "encryption_algorithm",
        "Weak encryption algorithm: %s",
        "Use AES-256-GCM or equivalent",
    ),
    "SOC2-CC7.2": (
        "soc2",
        "high",
        "audit_logging",
        "Audit logging is required",
        "Enable audit logging",
    ),
    "HIPAA-AUD-001": (
        "hipaa",
        "critical",
        "audit_logging",
        "Audit controls required for PHI access",
        "Enable comprehensive audit logging",
    ),
    "HIPAA-AUD-002": (
        "hipaa",
        "high",
        "audit_log_retention",
        "Audit log retention (%s days) below minimum",
        "Retain audit logs for at least 6 years (HIPAA)",
    ),
}

#: Ours: what cannot be read cannot be called compliant.
UNREADABLE_RULE = "CONFIG-READ-001"
RULES[UNREADABLE_RULE] = (
    "all",
    "high",
    pii.UNREADABLE,
    "Configuration is not a JSON object and could not be checked",
    "Store the configuration as a JSON object",
)


# -- personal data -----------------------------------------------------------


def scan_text(df: DataFrame, ids: Sequence[str], text: str = "text") -> DataFrame:
    """All hits in a text column with a hidden preview; whole texts are scanned."""
    found = df.select(*ids, F.explode(pii.hits(F.col(text))).alias("_h"))
    return found.select(
        *ids,
        F.col("_h.pii_type").alias("pii_type"),
        pii.preview(F.col("_h.pii_type"), F.col("_h.value")).alias("value_preview"),
        F.lit(pii.CONFIDENCE).alias("confidence"),
    )


def scan_json(df: DataFrame, ids: Sequence[str], document: str = "config") -> DataFrame:
    """Hits in every string of a JSON document, with its path as location."""
    candidates = df.where(pii.may_hit(F.col(document)))  # the rest need no parsing
    return scan_text(pii.json_strings(candidates, ids, document), [*ids, "location"])


def scan_counts(hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return hits.groupBy(*by, "pii_type").agg(F.count(F.lit(1)).alias("hits"))


# -- configuration checks ----------------------------------------------------


def _violation(rule: str, detail: Column | None = None, location: Column | None = None) -> Column:
    standard, severity, place, text, remedy = RULES[rule]
    return F.struct(
        F.lit(standard).alias("standard"),
        F.lit(rule).alias("rule_id"),
        (F.lit(text) if detail is None else F.format_string(text, detail)).alias("description"),
        F.lit(severity).alias("severity"),
        (F.lit(place) if location is None else location).alias("location"),
        F.lit(remedy).alias("remediation"),
    )


def check_contents(configs: DataFrame, standards: Sequence[str]) -> DataFrame:
    """Personal data in configurations and, under HIPAA, tell-tale top-level keys.

    A configuration that is not empty and no JSON object is a finding of its own: its keys and settings are
    unknown, and its text is scanned as a whole.
    """
    hits = scan_json(configs, ["id"], "config")
    out = hits.select(
        "id", _violation("GDPR-PII-001", F.col("pii_type"), F.col("location")).alias("_v")
    )
    text = F.col("config")
    unread = configs.where((text != "") & F.json_object_keys("config").isNull())
    out = out.unionByName(unread.select("id", _violation(UNREADABLE_RULE).alias("_v")))
    if "hipaa" in standards:
        keys = configs.select("id", F.explode(F.json_object_keys("config")).alias("key"))
        phi = keys.where(X.contains_any(F.lower("key"), PHI_KEYWORDS))
        out = out.unionByName(
            phi.select("id", _violation("HIPAA-PHI-001", F.col("key"), F.col("key")).alias("_v"))
        )
    return out.select("id", "_v.*")


def check_settings(configs: DataFrame, standards: Sequence[str]) -> DataFrame:
    """Encryption, audit and retention settings of configurations.

    Every rule is a conditional struct in one array, so a single pass over the
    table yields all violations.
    """
    setting = lambda key: F.get_json_object("config", f"$.{key}")
    encrypted = F.coalesce(F.lower(setting("encryption_enabled")) == "true", F.lit(False))
    algorithm = F.lower(F.coalesce(setting("encryption_algorithm"), F.lit("")))
    audited = F.coalesce(F.lower(setting("audit_enabled")) == "true", F.lit(False))
    audit_days = F.coalesce(
        setting("audit_retention_days").cast("long"), F.lit(DEFAULT_AUDIT_DAYS)
    )
    keep_days = setting("data_retention_days").cast("long")
    rules: list[Column] = [
        F.when(
            encrypted & X.contains_any(algorithm, WEAK_ALGORITHMS),
            _violation("SOC2-CC6.7", setting("encryption_algorithm")),
        )
    ]
    if "hipaa" in standards:
        rules += [
            F.when(~encrypted, _violation("HIPAA-ENC-001")),
            F.when(~audited, _violation("HIPAA-AUD-001")),
            F.when(
                audited & (audit_days < MIN_AUDIT_DAYS),
                _violation("HIPAA-AUD-002", audit_days.cast("string")),
            ),
        ]
    if "soc2" in standards:
        rules += [
            F.when(~encrypted, _violation("SOC2-CC6.1")),
            F.when(~audited, _violation("SOC2-CC7.2")),
        ]
    if "gdpr" in standards:
        rules.append(
            F.when(
                keep_days > MAX_RETENTION_DAYS,
                _violation("GDPR-RET-001", keep_days.cast("string")),
            )
        )
    return configs.select("id", F.explode(F.array_compact(F.array(*rules))).alias("_v")).select(
        "id", "_v.*"
    )


def check_configs(configs: DataFrame, standards: Sequence[str] = STANDARDS) -> DataFrame:
    """All violations of all configurations (columns id, config)."""
    return check_contents(configs, standards).unionByName(check_settings(configs, standards))


def compliance_status(configs: DataFrame, violations: DataFrame) -> DataFrame:
    """Violation count per configuration and whether it is free of them."""
    counts = violations.groupBy("id").agg(F.count(F.lit(1)).alias("_c"))
    return configs.select("id").join(counts, "id", "left").select(
        "id",
        F.coalesce("_c", F.lit(0)).alias("violations"),
        F.col("_c").isNull().alias("compliant"),
    )


def violations_by_severity(violations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return violations.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("violations"))


def _rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))


def report_lines(
    configs: DataFrame, violations: DataFrame, standards: Sequence[str] = STANDARDS
) -> DataFrame:
    """Compliance reports of all configurations as lines: (id, section, item, line).

    Section 0 is the head, 1-4 the severities from worst to least.
    """
    status = compliance_status(configs, violations)
    head = status.select(
        "id",
        F.lit(0).cast("long").alias("section"),
        F.lit("").alias("item"),
        F.concat(
            F.lit("# Compliance Report\n\nStandards Checked: " + ", ".join(standards) + "\n\n"),
            F.when(F.col("compliant"), "## Status: COMPLIANT\nNo violations detected.").otherwise(
                F.format_string("## Status: %d VIOLATIONS FOUND\n", "violations")
            ),
        ).alias("line"),
    )
    titles = violations_by_severity(violations, ["id"]).select(
        "id",
        _rank().alias("section"),
        F.lit("").alias("item"),
        F.format_string("### %s (%d)", F.upper("severity"), F.col("violations")).alias("line"),
    )
    body = violations.select(
        "id",
        _rank().alias("section"),
        F.concat_ws("/", "rule_id", "location", "description").alias("item"),
        F.format_string(
            "- **%s**: %s\n  - Location: `%s`\n  - Remediation: %s",
            "rule_id",
            "description",
            "location",
            "remediation",
        ).alias("line"),
    )
    return head.unionByName(titles).unionByName(body)
