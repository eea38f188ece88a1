"""Operators against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import jaccard, langid, pieces, sampling, token_counts
from tidelog.llm.common import table
from tidelog.llm.decontaminate import WinnowRule, contamination
from tidelog.llm.fertility import QualityRules, quality_rules, repeated_words
from tidelog.llm.graph import components
from tidelog.llm.jaccard import JaccardRule, jaccard_components
from tidelog.llm.main_text import extract_pages, main_text
from tidelog.llm.queries import URL_RULES
from tidelog.llm.repeats import WindowRule, remove_repeats
from tidelog.llm.site_quality import site_quality
from tidelog.llm.url_tree import TemplateRule, url_verdicts
from tidelog.llm.words import word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [None, "", " \t\n", "one", "One two", "one two three four", prose(3000)]
    base, passage = prose(120).split(), prose(60)
    out += [prose(rng.randint(5, 150)) for _ in range(60)]
    for _ in range(40):  # near copies at many distances
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    out += [prose(30) + "\n" + passage + " " + prose(20) for _ in range(12)]
    return out + [out[8], out[8], passage + " " + passage, "a " * 50, "### $$$ &&& " * 20, "\u2581 x\u2581y \u00e9\u4e2d\U0001f642  z"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts())]
    return out + [out[10], (None, out[12][1], None, None, None, None), (None, None, "xx", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0


@pytest.mark.parametrize("small", [1, jaccard.SMALL_BUCKET])
@pytest.mark.parametrize("rule", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard_components(docs, rows, rule, small, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    width, num, den = rule
    sets = {}
    for i, t, *_ in rows:
        w = words_of((t or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = jaccard_components(docs, JaccardRule(width, num, den)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_operators_on_an_empty_table(docs, spark):
    none = docs.where("false")
    assert jaccard_components(none, JaccardRule()).count() == 0
    assert remove_repeats(none, WindowRule()).count() == 0
    assert contamination(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert quality_rules(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert sampling.sampled_pieces(none).count() == 0
    assert langid.identify(none, *langid.learn(none)).count() == 0
    assert site_quality(none, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_pages(pages).count() == 0 and url_verdicts(pages, URL_RULES).count() == 0


def test_remove_repeats(docs, rows):
    count = collections.Counter()
    for _, t, *_ in rows:
        w = words_of(t)
        count.update(tuple(w[i : i + 20]) for i in range(len(w) - 19))
    want = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {j for k in range(len(w) - 19) if count[tuple(w[k : k + 20])] > 1 for j in range(k, k + 20)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in remove_repeats(docs, WindowRule(20, 7)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 500


def test_contamination(docs, rows, spark):
    items = [(1, rows[70][1]), (2, "one two three"), (3, None), (4, ""), (5, " ".join(rows[8][1].split()[2:14])), (10, rows[8][1]), (None, rows[9][1])]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t, *_ in rows:
        w, hit, names = split(t), set(), set()
        for item, text in items:
            v = split(text)
            m = min(10, len(v))
            windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v and item else set()
            at = [k for k in range(len(w) - m + 1) if m and tuple(w[k : k + m]) in windows]
            hit |= {j for k in at for j in range(k, k + m)}
            names |= {str(item)} if at else set()
        want.append((i, len(w), len(hit), len(names), sorted(names), bool(hit)))
    got = contamination(docs, spark.createDataFrame(items, "item_id int, text string"), WinnowRule(10, 5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(x[5] for x in want) > 3


def test_quality_rules(docs, rows):
    by_id = {r.doc_id: r for r in quality_rules(docs, QualityRules()).collect()}
    for i, t, *_ in rows:
        w, r = words_of(t), by_id[i]
        if i is None:
            continue
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert r.n_repeat_words == len(again) == repeated_words(word_hashes([x.encode() for x in w]), 5)
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        tokens = pieces.processor(pieces.MODEL).encode(w)
        assert r.n_tokens == sum(map(len, tokens))
        assert not (r.base_failed and r.kept)


def test_quality_rules_judge_short_texts(spark):
    prose = "The people of the town went to the river and came back with water in the evening of the same day".split()
    texts = [" ".join(prose[:12]), " ".join(prose), " ".join(f"\u16a0\u16a1\u16a2{chr(0x16A0 + i)}" for i in range(12)), " ".join(f"x{i}q#{i}zk{i}%" for i in range(20)), " ".join([*prose[:12], "\u16a0"])]
    rows = [(i, x, "en") for i, x in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), QualityRules()).collect()}
    assert [got[i].kept for i in range(len(texts))] == [True, True, False, False, True]
    assert not any(r.base_failed for r in got.values())


def test_token_counts_equal_a_unigram_tokenizer(docs, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = pieces.vocabulary()
    usual = v.logp > float("-inf")
    spelt = [(p if u or p.startswith("<0x") else f"\0{p}\0", float(x) if u else float(v.logp[usual].min())) for p, x, u in zip(v.pieces, v.logp, usual, strict=True)]
    library = Tokenizer(models.Unigram(spelt, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=pieces.MARK, prepend_scheme="always", split=True)
    for r in docs.join(token_counts.token_counts(docs).distinct(), "doc_id").select("text", "n_tokens").collect():
        assert r.n_tokens == (len(library.encode(r.text, add_special_tokens=False).ids) if r.text else 0)


def test_token_counts_with_runs_of_spaces(spark):
    from tokenizers import Tokenizer, models

    sp = pieces.processor(pieces.MODEL)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    usual = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(len(names))]
    v = pieces.vocabulary(runs=True)
    assert usual == (v.logp > float("-inf")).tolist() and sum(usual) == sum(pieces.vocabulary().logp > float("-inf")) + 14
    least = float(v.logp[usual].min())
    spelt = [(p if u or p.startswith("<0x") else f"\0{p}\0", float(x) if u else least) for p, x, u in zip(names, v.logp, usual, strict=True)]
    # Texts go in whole, with a mark in front and for each space: no cut between tokens.
    library = Tokenizer(models.Unigram(spelt, unk_id=0, byte_fallback=True))
    texts = ["b", " a", "  a", "x    b", " ", " " * 40, "if x:\n    y = 1\n\tz  =  2\n        return", "a\t\t b", "name      age   town \nAnn        31   Rome   ", "\u4e2d  \U0001f642   \n   e\u0301"]
    texts += ["word" + " " * n + "next" for n in range(1, 36)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(library.encode(pieces.MARK + t.replace(" ", pieces.MARK), add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert got[1] == 2 and got[3] - got[0] == 2


def test_sampled_pieces(docs, spark):
    out = sampling.sampled_pieces(docs)
    assert out.where("NOT lossless").count() == 0
    once = {r.doc_id: r.token_ids for r in out.collect()}
    again = {r.doc_id: r.token_ids for r in sampling.sampled_pieces(docs.repartition(2)).collect()}
    assert once == again
    other = {r.doc_id: r.token_ids for r in sampling.sampled_pieces(docs, sampling.SamplingRule(seed=1)).collect()}
    assert other != once and once[0] is None and once[1] == []
    # Shares of all segmentations of one word.
    v, word, n = pieces.vocabulary(runs=True), "thinning", 20_000
    number = {p: i for i, p in enumerate(v.pieces) if v.logp[i] > float("-inf")}

    def segmentations(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in number:
                i = number[rest[:k]]
                for tail, p in segmentations(rest[k:]):
                    yield (i, *tail), p * 2.718281828459045 ** v.logp[i]

    share = dict(segmentations(pieces.MARK + word))
    sampler = sampling.Sampler(sampling.SamplingRule())
    drawn = collections.Counter(tuple(x.tolist()) for x in sampler.encode([word] * n, list(range(n))))
    assert set(drawn) <= set(share)
    assert max(abs(drawn[s] / n - p / sum(share.values())) for s, p in share.items()) < 0.02


def test_language_id(spark):
    docs = table(spark, SF, "documents")
    known = docs.where("doc_id % 2 = 0")
    got = langid.identify(docs, *langid.learn(known)).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "thing " * 9), (5, "x" * 500)], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.identify(odd, *langid.learn(known)).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[4].lang_pred == "en" and 0 <= out[5].score <= 1


def test_forward_sums_all_segmentations():
    v = pieces.vocabulary()
    edges = pieces.edges_of([pieces.MARK + "the", pieces.MARK + "\u4e2d\u0000"], v)
    p = 2.718281828459045 ** v.logp
    alpha = langid.forward(edges, langid._probabilities(v, p[:, None], edges))
    number = {x: i for i, x in enumerate(v.pieces) if p[i] > 0}
    total = lambda s: 1.0 if not s else sum(p[number[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in number)
    assert alpha[edges.base[1] - 1, 0] == pytest.approx(total(pieces.MARK + "the"))
    assert alpha[edges.base[2] - 1, 0] > 0


def test_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name</header>
    <ul class="menu"><li><a href=x>Home</a><li><a>News</a></ul><div id=content><h2>Title</h2><p>First paragraph with quite a few words &amp; more
    words to be long enough for a surge.<p>Second   one <b>bold</b> text<div class="ad">Buy</div><p>Third.</p></div>
    <div id="comments"><p>I like this article very much, it is a great read, thanks for the very long text.</p></div><footer>(c)</footer></body></html>"""
    want = "Title\nFirst paragraph with quite a few words & more words to be long enough for a surge.\nSecond one bold text\nThird."
    assert main_text(page) == want
    assert main_text("<nav>x</nav><article><h1>A</h1><p>b<aside>no</aside><p>c</article><p>out") == "A\nb\nc"
    assert main_text("<p>unclosed <!-- never") == "" and main_text("<a <b> c" * 50) is not None
    pages = spark.createDataFrame([(1, "u", None, "clash"), (2, None, "", "x"), (3, "u", page, "x")], "page_id long, url string, html string, text string")
    assert {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()} == {1: ("", 0), 2: ("", 0), 3: (want, len(want))}


def test_main_text_beside_articles():
    body = [f"Paragraph {i} of the body with quite a few words, enough of them to be read as text." for i in range(4)]
    div = "<div>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    card = "<article><h3>Other story</h3><p>Short teaser.</p></article>"
    for page in (card + div, div + card, div[:-6] + card + div[5:], "<main><p>" + body[0] + "</p></main>" + div):
        assert set(body) <= set(main_text(page).split("\n"))
    # A lone short line or a list of links does not surge because of the tag.
    assert main_text("<article><p>Share</p></article>") == ""
    assert main_text("<main>" + "".join(f"<p><a href=x>Link number {i} with a long title that goes on and on</a></p>" for i in range(5)) + "</main>") == ""


def test_main_text_after_self_closed_and_unended_elements():
    text = "A paragraph with quite a few words, enough of them to be read as the text of a page."
    for tag in ('<svg class="icon"/>', "<math />", '<iframe src="x" />', "<video src=x>", "<canvas>", "<svg><path d='M0'/></svg>", "<SVG/><svg>no</SVG >"):
        assert main_text(f"<div>{tag}</div><p>{text}</p>") == text
        assert main_text(f"<p>{text}</p>{tag}<p>{text}</p>").split("\n") == [text, text]
    for tag in ("<script src=x />", "<style>", "<script>var t = '<p>"):
        assert main_text(f"<p>{text}</p>{tag}<p>{text}</p>") == text


def test_url_verdicts(spark):
    urls = [None, "", "nothing", "http://A.Example.ORG/es/1?x", "https://example.org/en/12", "http://x.org", "http://a.com/fr/1#y", "http://a.com/de", "http://a.com/de/9", "x://b.net/en/1"]
    urls += [f"http://c.example.org/en/1{i}/story-{i}" for i in range(30)] + [f"http://shop.com/list/{i}?p" for i in range(5)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_verdicts(pages, URL_RULES, TemplateRule()).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(10)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("a.com", "/fr/1", "com/fr/", "allow"), ("a.com", "/de", None, got[7].verdict),
        ("a.com", "/de/9", "com/de/", "block"), ("b.net", "/en/1", None, "allow"),
    ]
    assert len(got) == len(urls)


def test_url_templates_block_unruled_pages(spark):
    urls = [f"http://bad.example.com/de/{i}" for i in range(20)] + [f"http://good.example.com/fr/{i}" for i in range(20)]
    urls += [f"http://s{i}.farm.com/de/1" for i in range(40)] + [f"http://s{i}.fine.com/fr/1" for i in range(40)]
    asked = ["http://bad.example.com/en/7", "http://bad.example.com/about", "http://good.example.com/en/7", "http://new.farm.com/x", "http://new.example.com/x", "http://127.0.0.1/x"]
    pages = spark.createDataFrame(list(enumerate(asked + urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_verdicts(pages, URL_RULES, TemplateRule()).collect()}
    assert len(got) == len(pages.collect()) and all(got[i].rule is None for i in range(len(asked)))
    assert [got[i].verdict for i in range(len(asked))] == ["block", "block", "allow", "block", "allow", "allow"]
    # Without labels of its own, /en/ is merged with its labelled sibling of the same form; /about is not.
    assert [got[i].template for i in range(3)] == ["/*/#", "/about", "/*/#"]
    # 42 labelled hosts of .com lie outside of farm.com, one of them blocked; nothing is known outside of .com.
    assert got[3].purity == pytest.approx((40 + 10 * (1 + 10 * 0.0) / (42 + 10)) / (40 + 10))


def test_site_quality_prefers_good_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    out = site_quality(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id")
    mean = {r.quality: r.p for r in out.groupBy("quality").agg(F.avg("p_quality").alias("p")).collect()}
    assert mean[1] > mean[0] + 0.1
    unlabelled = site_quality(docs, labels.where("false"), F.col("source"), F.col("lang"))
    assert {r.p_quality for r in unlabelled.select("p_quality").distinct().collect()} == {0.5}


def test_pipeline_stages(spark, docs):
    """Each stage on the fixture: columns stay, decisions take effect."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        out = out.cache()
        assert out.count() <= kept.count()
        kept = out
    assert kept.where("text IS NULL OR text = ''").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.where("lossless").count() == kept.count()


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, rows):
    found = {r.doc_id: r.component_id for r in jaccard_components(docs, corpus_pipeline.NEAR_DUPLICATES).collect()}
    left = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert sorted(x for x in left if x is not None) == sorted({c for c in found.values() if c is not None})


def test_digest_of_kept_words(docs):
    r = remove_repeats(docs, WindowRule(35)).where("doc_id = 5").withColumn("sha", F.sha2("kept", 256)).first()
    assert r.sha == hashlib.sha256(b"one two three four").hexdigest()
