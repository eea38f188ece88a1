"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.byte_bpe import bpe_decode, bpe_encode, read_ranks
from tidelog.llm.collocations import PhraseRule, collocations, phrase_counts
from tidelog.llm.common import table
from tidelog.llm.decontaminate import WinnowRule, contamination
from tidelog.llm.fertility import QualityRules, quality_rules
from tidelog.llm.fill_middle import FillRule, fill_in_middle, restored
from tidelog.llm.jaccard import JaccardRule, jaccard_components
from tidelog.llm.langid import identify, learn
from tidelog.llm.main_text import LineBlockRule, extract_pages
from tidelog.llm.repeats import WindowRule, remove_repeats
from tidelog.llm.sampling import SamplingRule, sampled_pieces
from tidelog.llm.site_quality import SiteRule, site_quality
from tidelog.llm.token_counts import token_counts
from tidelog.llm.url_tree import TemplateRule, url_verdicts
from tidelog.plans.base import Registry

REGISTRY = Registry()
query = REGISTRY.add


WORDS_SQL = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER_SQL = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""WITH RECURSIVE d AS (
  SELECT doc_id, coalesce({WORDS_SQL.format(text=LOWER_SQL.format(text="text"))}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""


@query("op1_ngram_jaccard_join", JACCARD_SQL)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), JaccardRule(width=4, num=85, den=100))


REPEATS_SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({WORDS_SQL.format(text="text")}, []) AS w FROM documents),
s AS (SELECT row, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
c AS (SELECT row, i, count(*) OVER (PARTITION BY h) AS n FROM s),
hit AS (SELECT DISTINCT row, j FROM c, unnest(range(i, i + 35)) AS u(j) WHERE n > 1),
kept AS (
  SELECT row, string_agg(w[k], ' ' ORDER BY k) AS t, count(*) AS n
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS k FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.row = x.row AND hit.j = x.k) GROUP BY row)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)"""


@query("op4_substring_dedup", REPEATS_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), WindowRule(words=35))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SHARED_SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(list_filter(regexp_split_to_array({LOWER_SQL.format(text="text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''), []) AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array({LOWER_SQL.format(text="text")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
g AS (
  SELECT row, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM d, (SELECT DISTINCT m FROM i), unnest(range(1, len(w) - m + 2)) AS u(i)),
h AS (SELECT row, g.i, g.m, item_id FROM g JOIN i ON i.m = g.m AND i.g = g.g),
p AS (SELECT row, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + m)) AS u(j) GROUP BY row),
t AS (
  SELECT row, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (row) LEFT JOIN t USING (row)"""


@query("op10_benchmark_decontamination", SHARED_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WinnowRule(words=10, gram=5))
    digest = F.sha2(F.concat_ws(",", "item_list"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op3_quality_rules")
def fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), QualityRules()).drop("lang")


@query("op5_token_counts")
def unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query("op7_sampled_segmentation")
def sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(table(spark, sf_dir, "documents"), SamplingRule())


@query("op2_site_quality")
def hierarchical_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for a document's host, source and language for its path."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return site_quality(docs, labels, F.col("source"), F.col("lang"), SiteRule())


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op6_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, TemplateRule())


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    found = identify(docs.select("doc_id", "text"), *learn(known))
    return found.withColumn("held_out", held_out)


@query("op9_main_text")
def main_text_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), LineBlockRule())


@query("op11_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe_encode(table(spark, sf_dir, "documents"), ranks)
    digest = F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256)
    with_digest = encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "token_ids")
    return bpe_decode(with_digest, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


FILL_SQL = """WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""


@query("op13_fill_in_middle", FILL_SQL)
def fill_in_middle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), FillRule(changed=90, suffix_first=20, seed=1))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


PHRASES_SQL = f"""WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL.format(text="text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS q, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT q, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM q),
v AS (
  SELECT lang, w1, lead(w1, 1) OVER z AS w2, lead(w1, 2) OVER z AS w3, lead(w1, 3) OVER z AS w4, lead(w1, 4) OVER z AS w5
  FROM t WINDOW z AS (PARTITION BY q ORDER BY i)),
g AS (
  SELECT lang, phrase, m, count(*) AS f
  FROM (SELECT lang, w1 AS phrase, 1 AS m FROM v UNION ALL SELECT lang, w1 || ' ' || w2, 2 FROM v UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3 FROM v
        UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM v
        UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5 FROM v)
  WHERE phrase IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
h AS (SELECT * FROM g WHERE f >= 100),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM h WHERE m > 1),
i AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, m)) AS t(k), unnest(range(1, m - k + 2)) AS u(i) GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:m], ' ') AS rest FROM o, unnest(range(1, m)) AS t(k)),
s AS (
  SELECT k.lang, k.phrase, a, l.f AS l, r.f AS r, n.n, k, CAST(CAST(1000 AS HUGEINT) * a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k JOIN n ON n.lang = k.lang JOIN h l ON l.lang = k.lang AND l.phrase = first_part JOIN h r ON r.lang = k.lang AND r.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000"""


@query("op12_phrase_collocations", PHRASES_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents"), PhraseRule(longest=5, least=100)), longest=5, top=2000)
