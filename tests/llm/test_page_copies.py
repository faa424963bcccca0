"""Page differencing beside marked menus and inside runs of near copies."""

import random

import pytest

from sherdloom.llm import pages


def texts(spark, rows):
    got, at = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"])
    return {r.page_id: r[at] for r in got.collect()}


def test_marked_menus_do_not_make_copies(spark):
    menu = "<nav>" + "".join(f"<li>item {k}</li>" for k in range(12)) + "</nav>"
    rows = [
        (k, f"http://a.net/{k:03d}", f"{menu}<div>Imprint</div><p>one {k}</p><p>two {k}</p><p>three {k}</p><div>Notice</div>")
        for k in range(12)
    ]
    got = texts(spark, rows)
    assert all(got[k] == f"one {k}\n\ntwo {k}\n\nthree {k}" for k in range(12))


def test_runs_of_near_copies_meet_a_sibling(spark):
    def page(body):
        return "<div>Site</div>" + "".join(f"<p>{x}</p>" for x in body) + "<div>Imprint</div>"

    rows = [(k, f"http://a.net/b{k:03d}", page([f"story {j}" for j in range(18)] + [f"own {k}"])) for k in range(30)]
    rows += [(100, "http://a.net/a", page(["first"] * 3)), (101, "http://a.net/z", page(["last"] * 3))]
    got = texts(spark, rows)
    assert all(got[k] == "\n\n".join([*(f"story {j}" for j in range(18)), f"own {k}"]) for k in range(30))


def text_of(html):
    return "\n\n".join(t for t, s in pages.lines(html) if s != pages.ASIDE_LINE)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div class=post><h1>Long post</h1><p>one two three</p></div><article><p>teaser</p></article>",
         "Long post\n\none two three\n\nteaser"),
        ('<article><div class="article-header"><h1>Title</h1><p>Lead</p></div><p>t</article>', "Title\n\nLead\n\nt"),
        ('<article><div class="header"><h1>Title</h1></div><p>t</article>', "Title\n\nt"),
        ('<article><p class="ad-hoc">a</p><p class="share-price">b</p><p class="related-work">c</p></article>', "a\n\nb\n\nc"),
        ("<h1>Title</h1><article><p>a b c</article><h1>after</h1>", "Title\n\na b c"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>", "so x=1 holds"),
        ('<div class="site-header">s</div><div id="adSlot3">a</div><div class="post-comments">c</div><p>t', "t"),
        ('<div class="related-posts">r</div><div class="ad-300x250">a</div><div class="entry-footer">f</div><p>t', "t"),
    ],
)
def test_markup_leaves_article_text(html, want):
    assert text_of(html) == want


def test_long_shared_lines_go_like_short_ones(spark):
    for words in (39, 40, 400):
        notice = " ".join(f"w{k}" for k in range(words))
        rows = [(k, f"http://a.net/{k}", f"<p>{notice}</p><p>story {k}</p><p>end {k}</p>") for k in range(6)]
        assert texts(spark, rows) == {k: f"story {k}\n\nend {k}" for k in range(6)}


def test_site_names_in_headings_go_and_titles_stay(spark):
    rows = [(k, f"http://a.net/{k}", f"<h1>Site</h1><h1>Title {k}</h1><article><p>a {k}<p>b {k}<p>c {k}</article>") for k in range(6)]
    assert texts(spark, rows) == {k: f"Title {k}\n\na {k}\n\nb {k}\n\nc {k}" for k in range(6)}


def lcs_length(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def test_alignments_in_pieces_are_longest(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(pages, "ALIGNED", 7)
    for _ in range(400):
        a = [rng.randrange(5) for _ in range(rng.randrange(60))]
        b = [rng.randrange(5) for _ in range(rng.randrange(60))]
        got = pages.shared_lines(a, b)
        assert got == sorted(set(got)) and len(got) == lcs_length(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in got)


def test_one_line_repeated_many_times():
    n = 20_000
    mine = [x for k in range(n) for x in (0, 2 * k + 1)]
    other = [x for k in range(n) for x in (2 * k + 2, 0)]
    assert [mine[k] for k in pages.shared_lines(mine, other)] == [0] * n
