"""Evidence, moments and posteriors against the same formulas in plain Python."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.site_quality import BINS, BUCKETS, WIDTH, SiteRule, site_quality, word_buckets


def fixture():
    rng = random.Random(6)
    good, bad = [f"fine{i}" for i in range(30)], [f"junk{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(90):
        kind = rng.random() < 0.6
        words = [rng.choice(good if kind == (rng.random() < 0.8) else bad) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(words), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), "clash"))
        if rng.random() < 0.7:
            labels.append((i, int(kind)))
    rows += [(90, None, "a", "x", ""), (91, "", "zz", None, ""), (92, "fine1 " * 5000, "a", "y", ""), rows[3], rows[3], (None, "fine2 junk3", "b", "x", None)]
    labels += [(5, 0), (5, 1), (90, 1), (None, 1), (7, None), (999, 0)]
    return rows, labels


def weight_of(sites, rule, overall):
    """Prior weight from (n, good, centre) of the sites with labels."""
    n, n2 = sum(s[0] for s in sites), sum(s[0] ** 2 for s in sites)
    spread = sum(s[0] * (s[1] / s[0] - s[2]) ** 2 for s in sites)
    noise = overall * (1 - overall)
    if len(sites) < 2 or noise <= 0 or n * n <= n2:
        return rule.most_weight
    between = (spread - (len(sites) - 1) * noise) / (n - n2 / n)
    return rule.most_weight if between <= 0 else min(max(noise / between - 1, rule.least_weight), rule.most_weight)


def plain(rows, labels, half, rule):
    known = {}
    for key, value in labels:
        if key is not None and value is not None:
            known[key] = min(value, known.get(key, 1))
    count, n = np.zeros((2, BUCKETS)), [0, 0]
    for key, text, *_ in rows:
        if key in known and half[key] == 0:
            count[known[key], word_buckets(text.encode() if text else None)] += 1
            n[known[key]] += 1
    odds = np.log((count[1] + rule.smooth) / (n[1] + 2 * rule.smooth)) - np.log((count[0] + rule.smooth) / (n[0] + 2 * rule.smooth))

    def bin_of(text):
        found = word_buckets(text.encode() if text else None)
        return int(min(max(math.floor((odds[found].mean() if len(found) else 0.0) / WIDTH) + BINS // 2, 0), BINS - 1))

    bins = np.zeros((2, BINS))
    for key, text, *_ in rows:
        if key in known and half[key] == 1:
            bins[known[key], bin_of(text)] += 1
    ratio = [math.log((bins[1, b] + rule.smooth) / (bins[1].sum() + BINS * rule.smooth) / ((bins[0, b] + rule.smooth) / (bins[0].sum() + BINS * rule.smooth))) for b in range(BINS)]
    marked = [known[r[0]] for r in rows if r[0] in known]
    overall = (sum(marked) + 1) / (len(marked) + 2) if marked else 0.5
    hosts, paths = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for key, _, host, path, _ in rows:
        for site in (hosts[host], paths[host, path]):
            if key in known:
                site[0] += 1
                site[1] += known[key]
    host_weight = weight_of([(n, g, overall) for n, g in hosts.values() if n], rule, overall)
    mean = lambda g, n, centre, weight: (g + weight * centre) / (n + weight)
    centre = {h: mean(g, n, overall, host_weight) for h, (n, g) in hosts.items()}
    path_weight = weight_of([(n, g, centre[h]) for (h, _), (n, g) in paths.items() if n], rule, overall)
    out = []
    for key, text, host, path, _ in rows:
        own, own_good = int(key in known), known.get(key, 0)
        evidence = ratio[bin_of(text)]
        host_mean = mean(hosts[host][1] - own_good, hosts[host][0] - own, overall, host_weight)
        path_mean = mean(paths[host, path][1] - own_good, paths[host, path][0] - own, host_mean, path_weight)
        p = 1 / (1 + math.exp(-(math.log(path_mean / (1 - path_mean)) + evidence)))
        out.append((key, evidence, host_mean, path_mean, p, p >= rule.threshold))
    return out


@pytest.mark.parametrize("rule", [SiteRule(), SiteRule(threshold=0.7, smooth=0.5, least_weight=0.1, most_weight=20.0)])
def test_posteriors_equal_plain_python(spark, rule):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, evidence string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    got = sorted(site_quality(docs, marks, F.col("source"), F.col("lang"), rule).collect(), key=lambda r: (str(r.doc_id), r.p_quality))
    want = sorted(plain(rows, labels, half, rule), key=lambda r: (str(r[0]), r[4]))
    assert len(got) == len(rows)
    for a, b in zip(got, want, strict=True):
        assert a.doc_id == b[0] and a.kept == b[5]
        assert [a.evidence, a.host_mean, a.path_mean, a.p_quality] == pytest.approx(list(b[1:5]), abs=1e-9)
