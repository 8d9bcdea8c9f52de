"""Content safety: detectors over lines, path rules, decisions, redaction.

Detectors are rows, so a deployment can add its own; they compile into expressions
that run inside the scan, one pass per text and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import file_name

PLACEHOLDER = "[REDACTED]"
BLOCKED_TEXT = "[BLOCKED by firewall]"


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str  # a Java regular expression for one line
    type: str
    severity: str
    reason: str
    enabled: bool = True


# The built-in detectors, in the order in which they are tried.
DETECTORS = (
    Detector("private_key_block", r"-----BEGIN\s+(RSA|DSA|EC|OPENSSH)?\s*PRIVATE\s+KEY-----", "private_key", "high", "Potential private key block detected"),
    Detector("openai_api_key", r"sk-[A-Za-z0-9]{20,}", "api_key", "high", "Potential API credential detected"),
    Detector("aws_access_key", r"AKIA[0-9A-Z]{16}", "api_key", "high", "Potential AWS access key ID detected"),
    Detector("github_token", r"ghp_[A-Za-z0-9]{36}", "api_token", "high", "Potential GitHub personal access token detected"),
    Detector("github_app_token", r"gho_[A-Za-z0-9]{36}|ghu_[A-Za-z0-9]{36}", "api_token", "high", "Potential GitHub app/OAuth token detected"),
    Detector("database_url_with_credentials", r"(?iu)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s\"']+:[^\s\"']+@[^\s\"']+", "database_url", "high", "Potential database URL with embedded credentials detected"),
    Detector("bearer_token", r"(?iu)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "bearer_token", "medium", "Potential bearer token detected"),
    Detector("slack_token", r"xox[bpsa]-[0-9]{10,}-[A-Za-z0-9\-]+", "api_token", "high", "Potential Slack API token detected", False),
    Detector("generic_secret_assignment", r"""(?iu)(?:secret|api_?key|access_?key|private_?key|auth_?token|client_?secret)\s*=\s*['"][A-Za-z0-9\-._]{20,}['"]""", "secret_assignment", "medium", "Potential secret value assignment detected"),
)

# Paths that are never let through.
BLOCKED_NAMES = (".env", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
BLOCKED_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
SECRET_DATA_SUFFIXES = (".json", ".yaml", ".yml", ".env", ".ini", ".toml", ".txt", ".cfg", ".pem", ".key", ".p12")


def path_block(path: Column) -> Column:
    """Struct of severity and reason if a path rule blocks it, else null."""
    name = F.lower(file_name(path))
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    tell = lambda severity, reason: F.struct(F.lit(severity).alias("severity"), reason.alias("reason"))
    return (
        F.when(name.isin(*BLOCKED_NAMES), tell("high", F.concat(F.lit("Sensitive file detected: "), name)))
        .when(suffix.isin(*BLOCKED_SUFFIXES), tell("high", F.concat(F.lit("Sensitive file extension detected: "), suffix)))
        .when(name.startswith("secret") & suffix.isin(*SECRET_DATA_SUFFIXES), tell("medium", F.concat(F.lit("Secret config/data file detected: "), name)))
    )


def findings(files: DataFrame, detectors=DETECTORS, text: str = "source") -> DataFrame:
    """(path, line, detector, type, severity, reason, matches) of flagged lines.

    A line has a row for each detector that fits it; matches counts its findings. A
    text that no detector fits as a whole is not cut into lines.
    """
    on = [d for d in detectors if d.enabled]
    body = F.coalesce(F.col(text), F.lit(""))
    any_fit = F.lit(False)
    for d in on:
        any_fit = any_fit | F.rlike(body, F.lit(d.pattern))
    lines = files.where(any_fit).select("path", F.posexplode(F.split(body, "\n", -1)).alias("_at", "_line"))
    tests = F.array(*[
        F.when(F.rlike("_line", F.lit(d.pattern)), F.struct(
            F.lit(d.name).alias("detector"), F.lit(d.type).alias("type"), F.lit(d.severity).alias("severity"), F.lit(d.reason).alias("reason"),
            F.regexp_count("_line", F.lit(d.pattern)).cast("bigint").alias("matches"),
        )) for d in on
    ])
    hits = lines.select("path", (F.col("_at") + 1).cast("int").alias("line"), F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("x"))
    return hits.select("path", "line", "x.*")


def decisions(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, decision): block by path, else redact by a high or medium finding, else allow."""
    flagged = found.where(F.col("severity").isin("high", "medium")).select("path").distinct().withColumn("_f", F.lit(True))
    judged = files.select("path").distinct().join(flagged, "path", "left")
    return judged.select("path", F.when(path_block(F.col("path")).isNotNull(), "block").when(F.col("_f"), "redact").otherwise("allow").alias("decision"))


def redacted(text: Column, types: Column, lines: Column, detectors=DETECTORS, placeholder: str = PLACEHOLDER) -> Column:
    """text with every pattern of the found types replaced on the flagged lines.

    types and lines: arrays of the file's findings. All detectors of a type apply.
    """
    replaced = lambda line: _replace_all(line, types, detectors, placeholder)
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line, i: F.when(F.array_contains(lines, (i + 1).cast("int")), replaced(line)).otherwise(line)), "\n")


def _replace_all(line: Column, types: Column, detectors, placeholder: str) -> Column:
    for d in detectors:
        line = F.when(F.array_contains(types, F.lit(d.type)), F.regexp_replace(line, F.lit(d.pattern), F.lit(placeholder))).otherwise(line)
    return line


def safe_files(files: DataFrame, detectors=DETECTORS, enabled: bool = True, text: str = "source") -> DataFrame:
    """(path, decision, safe_source): what may leave; disabled, all passes."""
    if not enabled:
        return files.select("path", F.lit("allow").alias("decision"), F.col(text).alias("safe_source"))
    found = findings(files, detectors, text)
    per = found.groupBy("path").agg(F.collect_set("type").alias("_types"), F.collect_set("line").alias("_lines"), F.max(F.col("severity").isin("high", "medium")).alias("_f"))
    joined = files.join(per, "path", "left")
    block = path_block(F.col("path")).isNotNull()
    decision = F.when(block, "block").when(F.col("_f"), "redact").otherwise("allow")
    body = F.when(block, BLOCKED_TEXT).when(F.col("_f"), redacted(F.col(text), F.col("_types"), F.col("_lines"), detectors)).otherwise(F.col(text))
    return joined.select("path", decision.alias("decision"), body.alias("safe_source"))


def is_safe(decided: DataFrame) -> bool:
    return decided.where("decision <> 'allow'").isEmpty()
