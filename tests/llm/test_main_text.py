"""Pages that end anywhere, nest deeply or are short; the windows against a brute-force version."""

import random
import time

import pytest

from tidelog.llm.main_text import LineBlockRule, extract_pages, lines_of, main_text

TEXT = "Some text of a page, with quite a few words, enough of them to be read as main text here."


@pytest.mark.parametrize(
    "page",
    [
        f"<p>{TEXT}</p><div class=" + '"a" ' * 200 + '"',
        f"<p>{TEXT}</p><div " + '"' * 100_001,
        f"<p>{TEXT}</p>" + "<a " * 100_000,
        f"<p>{TEXT}</p>" + "<!" * 100_000,
        "<div>" * 100_000 + TEXT + "</span>" * 100_000,
        "<div>" * 100_000 + TEXT + "</div>" * 100_000,
        f"<p>{TEXT}</p>" + "<a '" * 100_001 + ">",
        f"<p>{TEXT}</p><!-- <b> never ended",
        f"<p>{TEXT}</p><scr",
    ],
)
def test_broken_pages_take_no_time(page):
    start = time.time()
    assert main_text(page) == TEXT
    assert time.time() - start < 5


@pytest.mark.parametrize("cut", range(0, 400, 7))
def test_a_page_cut_anywhere_gives_no_markup(cut):
    page = f"""<html><body><nav class="menu"><a href='/x'>Home</a></nav><article data-x="a>b"><h1>A title</h1><p>{TEXT}</p><p id='q'>{TEXT}</p></article></body></html>"""
    assert not set(main_text(page[:cut])) & set('<>"=')


def test_short_pages_keep_their_text():
    assert main_text("<article><p>Short news of one line.</p></article>") == "Short news of one line."
    assert main_text("<html><head><title>T</title></head><body><h1>Title here</h1><p>One short sentence.</p>") == "Title here\nOne short sentence."
    assert main_text("<nav><a>Home page link</a></nav><div class=footer>All rights are reserved</div>") == ""


def test_quotes():
    assert main_text(f"<p title='a>b'>{TEXT}</p>") == TEXT
    assert main_text(f'<p title="it\'s">{TEXT}</p>') == TEXT
    assert main_text(f"<p title=it's>{TEXT}</p>") == TEXT


def plain(lines, rule):
    """The same decisions line by line, each window added up anew."""
    size = [0 if dropped or (t and linked >= rule.links * len(t)) else len(t) + rule.bonus * article for t, article, dropped, linked in lines]
    windows = [sum(size[i : i + rule.window]) for i in range(len(size))]
    least = rule.least
    if windows and max(windows) < least:
        if all(not n or len(x[0].split()) < rule.words for x, n in zip(lines, size, strict=True)):
            return ""
        least = max(windows)
    out, surged = [], None  # None: no run; else whether it surged in an article
    for (t, article, dropped, _), n, window in zip(lines, size, windows, strict=True):
        if surged is not None and (window == 0 or (surged and not article)):
            surged = None
        if surged is None and n and window >= least:
            surged = article
        if surged is not None and not dropped:
            out.append(t)
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_windows_equal_brute_force(seed):
    rng = random.Random(seed)
    kinds = ["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>", "<article><p>{}</p></article>", "<p><a href=x>{}</a></p>", "<li>{}", "<aside>{}</aside>", "<article><h2>{}</h2></article>"]
    words = lambda: " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 2, 5, 12, 30])))
    page = "".join(rng.choice(kinds).format(words()) for _ in range(rng.randint(0, 30)))
    rule = LineBlockRule(window=rng.randint(1, 5), least=rng.choice([20, 80, 200]), bonus=rng.choice([0, 40]))
    assert main_text(page, rule) == plain(lines_of(page), rule)


def test_repeated_rows_and_long_pages(spark):
    long = "".join(f"<p>{TEXT} {i}</p>" for i in range(12_000))
    rows = [(1, "u", "<p>" + TEXT), (1, "u", "<p>" + TEXT), (None, None, long)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", len(TEXT))] * 2 + [("None", len(main_text(long)))])
    assert main_text(long).count("\n") == 11_999
