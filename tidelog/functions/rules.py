"""Log-line patterns and failure classification."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the replication product's log and report lines.
ABEND_LINE = r"(?i)(ABEND|PROCESS ABENDING|abended)"
ABEND_OR_STOP_LINE = r"(?i)(ABEND|PROCESS ABENDING|abended|STOPPED)"
PROCESS_NAME = r"(?i)(?:EXTRACT|REPLICAT|PUMP)\s+(\w+)"
ERROR_CODE = r"(OGG-\d+)"
TABLE_NAME = r"(?i)(?:TABLE|MAP)\s+(\w+\.\w+)"
STAMPED_LINE = r"^\d{4}-\d{2}-\d{2}T"
ERROR_LINE = r"ERROR|ABEND|OGG-"
STATUS_LINE = r"(?i)^(EXTRACT|REPLICAT)\s+(\w+)\s+.*Status\s+(\w+)"
STATUS_LINE_SHORT = r"(?i)^(EXTRACT|REPLICAT)\s+(\w+)\s+.*(RUNNING|STOPPED|ABENDED)"
LAG_LINE = r"(\w+)\s+.*?(\d+):(\d+):(\d+)"

# Failures a restart can cure (regular expressions).
TRANSIENT_ERRORS = {
    "OGG-00868": "TCP/IP connection timeout",
    "OGG-01234": "extract process stopped",
    "OGG-02075": "manager port conflict",
    "SQLException: Connection refused": "Snowflake connection refused",
    "Warehouse .* is suspended": "Snowflake warehouse suspended",
    "429": "Snowflake rate limited",
    "OGG-00446": "TCP/IP error: connection reset",
    "OGG-01031": "process restart required",
    "OGG-02089": "extract lag exceeded threshold",
    "ORA-03113": "end-of-file on communication channel",
    "ORA-03114": "not connected to Oracle",
    "ORA-12170": "TNS connect timeout",
    "ORA-12541": "TNS no listener",
    "ORA-12543": "TNS destination host unreachable",
}

# Failures that need a person (literal texts).
PERMANENT_ERRORS = {
    "OGG-01004": "table not found in source",
    "OGG-01028": "missing primary key",
    "OGG-01163": "DDL not supported",
    "OGG-02091": "DDL change detected",
    "OGG-01194": "credential expired",
    "OGG-01168": "column not found",
    "OGG-01027": "table definition mismatch",
    "OGG-01161": "bad column mapping",
    "OGG-06439": "handler configuration error",
}
# Fixed value: what an error is called that no rule names.
UNKNOWN_ERROR = "Unrecognized error pattern"


@dataclass(frozen=True)
class Rule:
    error_class: str
    pattern: str
    description: str
    literal: bool

    @property
    def label(self) -> str:
        return f"{self.pattern}: {self.description}"

    def matches(self, text: Column, lowered: Column) -> Column:
        if self.literal:
            return F.contains(lowered, F.lit(self.pattern.lower()))
        return text.rlike(f"(?i){self.pattern}")


def default_rules() -> list[Rule]:
    """Permanent rules come first, so they win when both kinds match."""
    return [Rule("PERMANENT", p, d, True) for p, d in PERMANENT_ERRORS.items()] + [
        # A plain code is cheaper as a literal test than as a regular expression.
        Rule("TRANSIENT", p, d, re.escape(p).replace(r"\-", "-").replace(r"\ ", " ") == p)
        for p, d in TRANSIENT_ERRORS.items()
    ]


def first_rule(text: Column, rules: list[Rule], lowered: Column | None = None) -> Column:
    """Position of the first rule that matches; the number of rules if none does.

    ``lowered`` may name a column that holds the text in lower case already, which
    saves doing that once per rule.
    """
    low = F.lower(text) if lowered is None else lowered
    found = F
    for i, rule in enumerate(rules):
        found = found.when(rule.matches(text, low), i)
    return F.lit(len(rules)) if found is F else found.otherwise(len(rules))


def rule_result(position: Column, rules: list[Rule]) -> Column:
    """struct(error_class, error_pattern) of a position given by ``first_rule``."""
    results = [(r.error_class, r.label) for r in rules] + [("UNKNOWN", UNKNOWN_ERROR)]
    named = [
        F.struct(F.lit(kind).alias("error_class"), F.lit(label).alias("error_pattern")) for kind, label in results
    ]
    return F.element_at(F.array(*named), position + 1)


def classify(text: Column, rules: list[Rule] | None = None) -> Column:
    """struct(error_class, error_pattern): the first matching rule in list order."""
    chosen = default_rules() if rules is None else rules
    return rule_result(first_rule(text, chosen), chosen)


def last_match(text: Column, pattern: str) -> Column:
    """First group of the last match in the text, null without a match."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))


def process_name(line: Column) -> Column:
    """Upper-cased process named in a log line, null when none is."""
    return F.nullif(F.upper(F.regexp_extract(line, PROCESS_NAME, 1)), F.lit(""))


def stamped_at(line: Column) -> Column:
    """The time a log line starts with, null for lines without one."""
    return F.try_to_timestamp(F.substring(line, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
