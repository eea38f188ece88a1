"""Log and report lines: detection, context, classification, status.

Lines come as (file, block, row, value): ``block`` and ``row`` give the order
inside a file (see ``tidelog.sources.logs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import rules, status
from tidelog.operators.ordered import OrderedRows, SkewGuard

LINE_ORDER = ["block", "row"]
EVENT_TAIL, RECOVERY_TAIL = 50, 80


def tail_lines(lines: DataFrame, n: int, by: list[str] = ("file",), order: list[str] = LINE_ORDER) -> DataFrame:
    """Last n lines per file; each task keeps n before anything is shuffled."""
    last = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return lines.withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") <= n).drop("__rn")


def recent_errors(
    lines: DataFrame, cutoff: Column, shown: int | None = 15, order: list[str] = LINE_ORDER, guard: SkewGuard = SkewGuard(),
    count_rest: bool = False,
) -> DataFrame:
    """Error lines since a minute (``yyyy-MM-ddTHH:mm`` text), newest ``shown`` per file; ``count_rest`` adds how many
    older ones of the file these leave out (``left_out``), for one more pass.

    A line without a time stamp is as recent as the last stamped one before it.
    """
    stamp = F.when(F.col("value").rlike(rules.STAMPED_LINE), F.substring("value", 1, 16))
    dated = OrderedRows(lines, ["file"], order, guard).last_known({"stamp": stamp}).frame()
    hits = dated.where((F.col("stamp") >= cutoff) & F.col("value").rlike(rules.ERROR_LINE))
    if shown is None or not count_rest:
        return hits if shown is None else tail_lines(hits, shown, order=order)
    more = hits.groupBy("file").agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("left_out"))
    return tail_lines(hits, shown, order=order).join(more, "file")


def error_window(lines: DataFrame, now: Column, minutes: int = 10, shown: int = 3, pattern: str = "ERROR|ABEND|FATAL") -> DataFrame:
    """Per file: error lines of the last minutes, the newest of them, and how many those leave out.

    Needs a ``ts`` column.
    """
    hits = lines.where((F.col("ts") >= now - F.make_interval(mins=F.lit(minutes))) & F.col("value").rlike(pattern))
    counted = hits.groupBy("file").agg(F.count(F.lit(1)).alias("errors"))
    last = Window.partitionBy("file").orderBy(F.desc("ts"), *[F.desc(c) for c in LINE_ORDER])
    newest = (
        hits.withColumn("__rn", F.row_number().over(last))
        .where(F.col("__rn") <= shown)
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("__rn", "value"))).getField("value").alias("newest"))
    )
    return counted.join(newest, "file").withColumn("left_out", F.col("errors") - F.size("newest"))


def abend_events(lines: DataFrame, pattern: str = rules.ABEND_LINE) -> DataFrame:
    """Lines that report a failed process, with its name. Works on streams too.

    Lines that name no process keep a null name; the caller drops or counts them.
    """
    return lines.where(F.col("value").rlike(pattern)).withColumn("process_name", rules.process_name(F.col("value")))


def named_events(events: DataFrame) -> DataFrame:
    return events.where("process_name IS NOT NULL")


def report_details(reports: DataFrame, n: int = EVENT_TAIL, by: str = "process_name", order: list[str] = LINE_ORDER) -> DataFrame:
    """From the last n report lines of each process: last error code, the message
    line, the failing table and the excerpt itself (at most n lines)."""
    return _details(tail_lines(reports, n, [by], order), [by], order)


def _details(tails: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Details of each tail; a tail is a few lines at most."""
    tail = tails.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).getField("value").alias("__lines"))
    lines = F.col("__lines")
    last = lambda found: F.try_element_at(F.array_compact(found), F.lit(-1))
    coded = tail.withColumns(
        {
            "error_code": last(F.transform(lines, lambda v: rules.last_match(v, rules.ERROR_CODE))),
            "failing_table": F.upper(last(F.transform(lines, lambda v: rules.last_match(v, rules.TABLE_NAME)))),
        }
    )
    # The message is the last line with the code or an error word, whichever is later.
    telling = lambda v: (
        F.coalesce(F.contains(v, "error_code"), F.lit(False)) | F.upper(v).contains("ERROR") | F.upper(v).contains("ABEND")
    )
    return coded.select(
        *by,
        "error_code",
        F.trim(last(F.filter(lines, telling))).alias("error_message"),
        "failing_table",
        F.array_join(lines, "\n").alias("excerpt"),
    )


def with_rule(df: DataFrame, text: str, rule_list: list[rules.Rule], name: str) -> DataFrame:
    """Add the position of the first rule that matches a text column."""
    lowered = df.withColumn("__low", F.lower(text))
    return lowered.withColumn(name, rules.first_rule(F.col(text), rule_list, F.col("__low"))).drop("__low")


def classified(df: DataFrame, text: str = "value", rule_list: list[rules.Rule] | None = None) -> DataFrame:
    """Add error_class and error_pattern of a text column. Works on streams too."""
    chosen = rules.default_rules() if rule_list is None else rule_list
    found = with_rule(df, text, chosen, "__rule").withColumn("__c", rules.rule_result(F.col("__rule"), chosen))
    return found.select("*", "__c.*").drop("__c", "__rule")


def _judged(events: DataFrame, details: DataFrame, by: list[str], rule_list: list[rules.Rule] | None) -> DataFrame:
    """A report is matched against the rules once, a line once per event; the rule that comes first in the list wins."""
    chosen = rules.default_rules() if rule_list is None else rule_list
    details = with_rule(details, "excerpt", chosen, "__in_report")
    lines = with_rule(events, "value", chosen, "__in_line")
    position = F.least("__in_line", "__in_report")
    joined = lines.join(details, by, "left")
    return joined.withColumn("__c", rules.rule_result(position, chosen)).select("*", "__c.*").drop("__c", "__in_line", "__in_report")


def enrich_events(events: DataFrame, reports: DataFrame, n: int = RECOVERY_TAIL, rule_list: list[rules.Rule] | None = None) -> DataFrame:
    """Events with the details of the reports as they are now and the failure class of line and report."""
    return _judged(named_events(events), report_details(reports, n), ["process_name"], rule_list)


def enrich_events_as_of(
    events: DataFrame,
    reports: DataFrame,
    at: str,
    n: int = RECOVERY_TAIL,
    rule_list: list[rules.Rule] | None = None,
    order: list[str] = LINE_ORDER,
    guard: SkewGuard = SkewGuard(),
) -> DataFrame:
    """As ``enrich_events``, but each event sees the report as it was: the last n lines up to its own ``at``.

    Lines and events of a process are merged into one ordered stream that numbers the lines, so an event knows the
    number of the last line before it. Lines lie in blocks of n; a tail is cut out of two blocks. Neither shuffle
    brings a process together, and events between the same two lines share one tail.
    """
    by, events = "process_name", named_events(events)
    lines = reports.select(by, F.col(at).alias("__at"), F.lit(0).alias("__ask"), *[F.col(c).alias(f"__{c}") for c in order], "value")
    asked = events.select(by, F.col(at).alias("__at"), F.lit(1).alias("__ask")).distinct()
    merged = lines.unionByName(asked, allowMissingColumns=True)
    rows = OrderedRows(merged, [by], ["__at", "__ask", *[f"__{c}" for c in order]], guard)
    numbered = rows.running_sum({"__no": (1 - F.col("__ask")).cast("bigint")}).frame()
    asked = numbered.where("__ask = 1").select(by, F.col("__at").alias(at), "__no")
    block = lambda no: F.floor((no - 1) / n)
    places = asked.where("__no > 0").select(by, "__no").distinct()
    halves = F.explode(F.array_distinct(F.array(block(F.col("__upto")), F.greatest(block(F.col("__upto")) - 1, F.lit(0)))))
    wanted = places.withColumnRenamed("__no", "__upto").withColumn("__block", halves)
    cut = numbered.where("__ask = 0").withColumn("__block", block(F.col("__no"))).select(by, "__block", F.col("__no").alias("__line"), "value")
    inside = (F.col("__line") <= F.col("__upto")) & (F.col("__line") > F.col("__upto") - n)
    tails = wanted.join(cut, [by, "__block"]).where(inside)
    details = _details(tails, [by, "__upto"], ["__line"]).withColumnRenamed("__upto", "__no")
    return _judged(events.join(asked, [by, at], "left"), details, [by, "__no"], rule_list).drop("__no")


def process_status(lines: DataFrame, order: list[str] = LINE_ORDER) -> DataFrame:
    """Latest status per process from status listings, with its severity."""
    value = F.trim("value")
    pick = lambda i: F.coalesce(
        F.nullif(F.regexp_extract(value, rules.STATUS_LINE, i), F.lit("")),
        F.nullif(F.regexp_extract(value, rules.STATUS_LINE_SHORT, i), F.lit("")),
    )
    parsed = lines.select(F.upper(pick(2)).alias("process_name"), F.upper(pick(3)).alias("status"), *order)
    return (
        parsed.where("process_name IS NOT NULL AND status IS NOT NULL")
        .groupBy("process_name")
        .agg(F.max_by("status", F.struct(*order)).alias("status"))
        .withColumn("severity", status.process_severity(F.col("status")))
    )


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("processes"))


def lag_lines(lines: DataFrame, scale=status.MONITOR_LAG) -> DataFrame:
    """Lag rows printed as ``NAME ... H:M:S``, rated; every slow process is kept."""
    seconds = status.hms_seconds(F.col("value"))
    return (
        lines.where(F.col("value").rlike(rules.LAG_LINE))
        .withColumn("process_name", F.regexp_extract(F.ltrim("value"), r"^(\S+)", 1))
        .withColumn("lag_seconds", seconds)
        .withColumn("severity", status.lag_status(F.col("lag_seconds"), scale))
    )
