"""Text rules: credential redaction and question routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.columns import as_col

# What is redacted, in order; header forms come before the generic ones.
REDACTIONS = (
    (r"(?i)(authorization\s*:\s*)bearer\s+[A-Za-z0-9._~+\-/=]+", "$1[REDACTED]"),
    (r"(?i)(x-api-key\s*:\s*)[A-Za-z0-9._~+\-/=]+", "$1[REDACTED]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+\-/=]+", "$1[REDACTED]"),
    (r"(?i)(api[_-]?key\s*[:=]\s*)[A-Za-z0-9._~+\-/=]+", "$1[REDACTED]"),
    (r"(?i)(password\s*[:=]\s*)[^\s,;]+", "$1[REDACTED]"),
    (r"(?i)(postgres(?:ql)?://[^:/@\s]+:)([^@/\s]+)(@)", "$1[REDACTED]$3"),
    (r"(?i)(database_url\s*[:=]\s*)postgres(?:ql)?://[^\s]+", "$1[REDACTED]"),
    (
        r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
        "[PRIVATE KEY REDACTED]",
    ),
)

# Words that decide where a question goes, classes in order of priority.
ROUTES = {
    "traffic": (r"traffic", r"requests", r"errors?", r"error rate", r"status", r"events?", r"show.*(429|error|traffic)"),
    "documentation": (
        r"429",
        r"rate limit",
        r"retry after",
        r"too many requests",
        r"why.*rate",
        r"why.*429",
        r"what does.*429",
        r"how does.*rate",
        r"how.*token bucket",
        r"what does.*readiness",
        r"how.*tenant isolation",
    ),
    "anomaly": (r"anomaly", r"outlier", r"suspicious", r"spike", r"trending"),
    "incident": (r"incident", r"outage", r"down", r"what should i do", r"escalat"),
    "forecast": (r"forecast", r"next hour", r"predict", r"projection"),
}
DEFAULT_ROUTE = "documentation"


def redact(c) -> Column:
    text = F.coalesce(as_col(c), F.lit(""))
    for pattern, put in REDACTIONS:
        text = F.regexp_replace(text, pattern, put)
    return text


def redaction_count(c) -> Column:
    """How many places the redactions change, each counted on the text left by the ones before."""
    text, total = F.coalesce(as_col(c), F.lit("")), F.lit(0)
    for pattern, put in REDACTIONS:
        total = total + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, put)
    return total


def route_question(c) -> Column:
    """The class of a question: the first class, in order, one of whose patterns occurs."""
    lowered = F.lower(as_col(c))
    chain = None
    for name, patterns in ROUTES.items():
        hit = lowered.rlike("|".join(patterns))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise(DEFAULT_ROUTE)
