"""URL filters by a path-template tree, in DataFrame functions only.

Paths are reduced to shapes (runs of digits become ``#``), their first ``depth`` segments are
the levels of a tree per host, and the rest is one last level. Level by level

1. a branching point with many values that are mostly met once is variable: its segments become ``*``;
2. sibling branches whose share of labelled blocked pages is within ``z`` standard errors of that of
   all siblings are merged into ``*`` as well;
3. a branch without labels joins them if one of them has its form, the commonest rest of a path below it.

What remains are templates. Pages that a rule decides are the labels. A template's purity, the share of blocked pages
among its labelled ones, is smoothed towards that of the path above it, and so on up to its host, the domains
around the host and all hosts; templates above ``reject`` are blocked, with labels of their own or without. Each label
counts at one level only. For domains a host is one observation, however many pages it has, and all hosts are smoothed
towards none blocked: a page of which little is known is allowed.

Everything after the first aggregate works on distinct shapes with counts, and every grouping is a
sum that is partly made before the shuffle, so a hot host is a matter of few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.decontaminate import LETTERS


@dataclass(frozen=True)
class TemplateRule:
    depth: int = 4
    many: int = 8  # a variable branching point has at least so many values ...
    rare: int = 2  # ... of at most so many pages each, on average
    z: float = 2.0
    prior: float = 10.0  # labelled pages (or hosts, for domains) that the level above counts as
    reject: float = 0.5


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` and for null."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), LETTERS, LETTERS.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: str, path: str, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, rule) that fits; null if none does.

    A rule ``domain/prefix`` fits its domain and all subdomains, where the path starts with ``/prefix``.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, _, prefix = rule.partition("/")
        at_host = (F.col(host) == domain) | F.col(host).endswith("." + domain)
        fits = at_host & F.col(path).startswith("/" + prefix)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _levels(path: str, depth: int) -> Column:
    """Shapes of the first ``depth`` segments and of the rest as one; no empty ones at the end."""
    shape = F.regexp_replace(F.regexp_replace(F.col(path), r"/+$", ""), r"\p{Nd}+", "#")
    parts = F.split(F.regexp_replace(shape, "^/", ""), "/", depth + 1)
    return F.when(shape == "", F.array().cast("array<string>")).otherwise(parts)


def template_verdicts(pages: DataFrame, rule: TemplateRule) -> DataFrame:
    """(host, levels, template, purity, verdict) for the distinct (host, levels) of ``pages``
    (host, levels, label: 1 for blocked, 0 for allowed, null without label)."""
    counts = [F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.sum(F.coalesce("label", F.lit(0))).cast("long").alias("bad")]
    tree = written(pages.groupBy("host", "levels").agg(*counts)).withColumn("template", F.array().cast("array<string>"))
    for level in range(rule.depth + 1):
        here = F.when(F.size("levels") > level, F.col("levels").getItem(level))
        node = ["host", "template"]
        # The rest of the path below the branch.
        form = F.concat_ws("/", F.slice("levels", level + 2, rule.depth + 1)).alias("form")
        forms = tree.withColumn("here", here).where("here IS NOT NULL").groupBy(*node, "here", form).agg(*[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        commonest = F.max(F.struct("n", "form")).getField("form").alias("form")
        branch = forms.groupBy(*node, "here").agg(commonest, *[F.sum(c).alias(c) for c in ("n", "known", "bad")])
        # Windows per branching point would gather a hot host in one task: sums per node are joined back.
        sums = branch.groupBy(*node).agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n_all"), F.sum("known").alias("known_all"), F.sum("bad").alias("bad_all"))
        branch = branch.join(sums, node)
        share = F.col("bad_all") / F.greatest("known_all", F.lit(1))
        error = F.sqrt(share * (1 - share) / F.greatest("known", F.lit(1)))
        variable = (F.col("values") >= rule.many) & (F.col("n_all") <= F.col("values") * rule.rare)
        similar = (F.col("values") > 1) & (F.abs(F.col("bad") / F.greatest("known", F.lit(1)) - share) <= error * rule.z) & (F.col("known") > 0)
        branch = branch.select(*node, "here", "form", "known", variable.alias("variable"), similar.alias("similar"))
        joined = branch.where("similar").select(*node, "form").distinct().withColumn("joins", F.lit(True))
        merged = F.col("variable") | F.col("similar") | ((F.col("known") == 0) & F.coalesce("joins", F.lit(False)))
        renamed = branch.join(joined, [*node, "form"], "left").select(*node, "here", F.when(merged, "*").otherwise(F.col("here")).alias("name"))
        tree = tree.withColumn("here", here).join(renamed, [*node, "here"], "left")
        tree = written(tree.withColumn("template", F.when(F.col("name").isNotNull(), F.array_append("template", F.col("name"))).otherwise(F.col("template"))).drop("here", "name"))
    found = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    judged = _purities(written(found), rule)
    out = tree.select("host", "levels", "template").join(judged, ["host", "template"])
    return out.withColumn("verdict", F.when(F.col("purity") > rule.reject, "block").otherwise("allow"))


def _counted(n: Column | str, b: Column | str) -> Column:
    """struct(n, b): labelled and blocked ones."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(name) for c, name in ((n, "n"), (b, "b"))])


def _smoothed(above: Column, levels: Column, own: Column, prior: float) -> Column:
    """Share ``above``, then through ``levels`` (struct(n, b), outermost first): each counts what the next one, at last ``own``, does not."""
    inner = F.concat(F.slice(levels, 2, F.size(levels)), F.array(own))
    outside = F.zip_with(levels, inner, lambda x, y: F.struct((x.n - y.n).alias("n"), (x.b - y.b).alias("b")))
    return F.aggregate(outside, above, lambda p, x: (x.b + prior * p) / (x.n + prior))


def _domains(host: str) -> Column:
    """The host as a domain and all domains around it, the top-level one first; null for addresses and what is no domain name."""
    name = F.regexp_replace(F.regexp_replace(F.col(host), "(?s)^.*@", ""), r"\.?(:\d*)?$", "")
    usual = (F.length(name) <= 253) & name.rlike(r"^[^.:\[\]\s]+(\.[^.:\[\]\s]+)*$") & ~name.rlike(r"^[\d.]+$")
    parts = F.split(name, r"\.")
    return F.when(usual, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, -i, i))))


def _purities(found: DataFrame, rule: TemplateRule) -> DataFrame:
    """(host, template, purity) of ``found`` (host, template, known, bad)."""
    hosts = found.groupBy("host").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    # A host's share in millionths: sums of integers do not depend on their order.
    share = F.when(F.col("known") > 0, F.round(F.col("bad") * 1_000_000 / F.col("known")).cast("long")).otherwise(0)
    hosts = written(hosts.select("host", (F.col("known") > 0).cast("long").alias("n"), share.alias("b")))
    # One row of sums, known before: a literal rather than a join.
    top = hosts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    inside = hosts.select("host", "n", "b", F.posexplode(_domains("host")).alias("at", "domain"))
    domains = inside.where("n > 0").groupBy("domain").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    around = inside.select("host", "at", "domain").join(domains, "domain")
    around = around.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "n", "b"))).alias("around"))
    none = F.array().cast("array<struct<at:int,n:bigint,b:bigint>>")
    everywhere = F.array(_counted(F.lit(top.n or 0), F.lit((top.b or 0) / 1_000_000)))
    levels = F.concat(everywhere, F.transform(F.coalesce("around", none), lambda x: _counted(x.n, x.b / 1_000_000)))
    above = _smoothed(F.lit(0.0), levels, _counted("n", F.col("b") / 1_000_000), rule.prior)
    hosts = hosts.join(around, "host", "left").select("host", above.alias("above"))

    steps = F.transform(F.sequence(F.lit(0), F.size("template")), lambda i: F.slice("template", F.lit(1), i))
    inside = found.select("host", "template", "known", "bad", F.posexplode(steps).alias("at", "path"))
    paths = inside.groupBy("host", "path").agg(F.sum("known").alias("n"), F.sum("bad").alias("b"))
    inside = inside.select("host", "template", "known", "bad", "at", "path").join(paths, ["host", "path"])
    inside = inside.groupBy("host", "template", "known", "bad").agg(F.sort_array(F.collect_list(F.struct("at", "n", "b"))).alias("paths"))
    levels = F.transform("paths", lambda x: _counted(x.n, x.b))
    over = _smoothed(F.col("above"), levels, _counted("known", "bad"), rule.prior)
    purity = (F.col("bad") + rule.prior * over) / (F.col("known") + rule.prior)
    return inside.join(hosts, "host").select("host", "template", purity.alias("purity"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], tree: TemplateRule = TemplateRule(), key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, template, purity, verdict.

    ``verdict`` is the longest fitting rule's, else the template's. Null urls and urls without ``://`` have an empty host and path,
    which is a template like others.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", longest_rule("host", "path", rules)).withColumn("levels", _levels("path", tree.depth))
    label = F.when(F.col("ruled.verdict") == "block", 1).when(F.col("ruled.verdict") == "allow", 0)
    judged = written(template_verdicts(rows.select("host", "levels", label.alias("label")), tree))
    out = rows.join(judged, ["host", "levels"], "left")
    return out.select(
        F.col("key").alias(key), "host", "path", F.col("ruled.rule").alias("rule"), F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), "purity",
        F.coalesce(F.col("ruled.verdict"), F.col("verdict")).alias("verdict"),
    )

