import random
from collections import Counter
from itertools import product

import pytest

from sourcewell.llm.html_text import extract, host_of, parse

FRAME = '<!DOCTYPE html><html><head><title>t{i}</title><style>p{{x}}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar"><header><p>Site</p></header><nav><ul><li><a href="/x">Menu {i}</a></ul></nav><!-- ad --><div class="ad">Buy {i}</div><article><h1>T{i} &amp; more</h1>{body}<p>Share this story</p><form><p>mail?</p></form><section class="comments"><p>First! {i}</p></section></article><aside><article><h2>Other</h2></article></aside><footer>&copy; {i}</footer></body></html>'


def frame(spark, rows):
    return {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks int")).collect()}


def test_article_template_and_slots(spark):
    rows = [(i, f"https://H.example.com:80/{i}?q", FRAME.format(i=i, body=f"<p>Word  {i}\n x &lt;b&gt;<br>y<b>z<p>Common line</p><p>{'Twin' if i % 2 else 'Odd'}</p>"), "", 1) for i in range(12)]
    rows += [(100 + i, "http://small.example.com/", FRAME.format(i=1, body="<p>Same</p>"), "", 1) for i in range(3)]
    got = frame(spark, rows)
    for i in range(12):
        # "Share this story" and "Common line" are on every page of the host; "Twin" is on half of them.
        assert got[i].text == f"T{i} & more\nWord {i} x <b> yz\n{'Twin' if i % 2 else 'Odd'}"
        assert got[i].n_chars == len(got[i].text)
    assert got[101].text == "T1 & more\nSame\nShare this story"


def test_broken_and_empty_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "no markup at all"), (4, "http://a.b/", "<article><p>cut &amp; of"), (5, "http://a.b/", "<article><p>one</p><p>two</p></arti"), (6, "http://a.b/", "<p>a < b and c< d</p><p title='x>y'>q</p>"), (7, "http://a.b/", "<article>" + "<div>" * 3000 + "deep" + "<p>x</p>" * 3000), (8, "http://a.b/", '<article><p class="x>quote unclosed</p><p>after</p></article>')]
    got = frame(spark, [(*r, "", 0) for r in rows] + [(*rows[4], "", 0)])
    assert [got[i].text for i in range(1, 7)] == ["", "", "no markup at all", "cut & of", "one\ntwo", "a < b and c< d\nq"]
    assert got[7].text == "deep" + "\nx" * 3000
    assert "after" in got[8].text


def test_container_of_pages_without_an_article(spark):
    page = "<body><div class='top'><p><a href=x>link one link one link</a></p></div><div class='story'><p>{}</p><p>{}</p></div><div class='sidebar'><p>side</p></div></body>"
    rng = random.Random(4)
    word = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma"], k=n)) + str(rng.random())
    rows = [(i, f"http://n.example.org/{i}", page.format(word(30), word(40)), "", 0) for i in range(10)]
    got = frame(spark, rows)
    for i, _, html, *_ in rows:
        assert got[i].text == "\n".join(b[0] for b in parse(html)[1] if "story" in b[1])


def neutral(rng, i, kind):
    """A page of neutral tags: two divs of boilerplate, a div of text, a div below; texts of the first differ."""
    word = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=n)) + f" {rng.random()}"
    body = [word(rng.randint(8, 40)) for _ in range(rng.randint(2, 5))]
    body[1:1] = ["A line of the house"] if kind != "rare" or i % 9 == 0 else []
    below = "<div><b>Our partners</b></div><div><b>Our partners</b></div>" if i % 2 else "<ul><li>Monday list</ul>"
    if kind == "rare" and i == 5:
        below = ""
    page = f"<html><body><div>{word(3)}</div><div>Welcome to the house</div><div>" + "".join(f"<p>{x}</p>" for x in body) + f"<div>{below}</div></div><div>{word(4)}</div></body></html>"
    return page, "\n".join(x for x in body if kind == "rare" or x != "A line of the house")


@pytest.mark.parametrize("kind", ["common", "rare"])
def test_boilerplate_without_names_goes_by_deduction(spark, kind):
    """Nothing but occurrence vectors can tell: twice on every second page, on one kind of page, missing on a page."""
    rng = random.Random(kind)
    pages = [neutral(rng, i, kind) for i in range(20)]
    rows = [(i, f"http://plain.example.net/{i}", html, "", 0) for i, (html, _) in enumerate(pages)]
    rows += [(100 + k, "http://plain.example.net/copy", pages[3][0], "", 0) for k in range(30)]  # copies are one content
    got = frame(spark, rows)
    assert [got[i].text for i in range(20)] == [text for _, text in pages]
    assert got[100].text == pages[3][1]


def brute_classes(parsed):
    """Occurrence vectors written out, by token, for the pages of one host with different contents."""
    seen, vectors = [], {}
    for tags, blocks in parsed:
        content = (sorted(tags), [b[:2] for b in blocks])
        if content not in seen:
            seen.append(content)
            for token in [(p, None) for p, _ in tags] + [(b[1], b[0]) for b in blocks]:
                vectors.setdefault(token, Counter())[len(seen)] = tags[next(k for k in tags if k[0] == token[0])] if token[1] is None else sum((b[1], b[0]) == token for b in blocks)
    classes = {}
    for token, vector in vectors.items():
        classes.setdefault(tuple(sorted(vector.items())), set()).add(token)
    return vectors, classes, len(seen)


def test_classes_equal_vectors_written_out(spark):
    from sourcewell.llm import html_text as h
    from sourcewell.llm.common import map_texts, stored

    rng = random.Random(8)
    pages = [neutral(rng, i, "rare")[0] for i in range(14)] + [FRAME.format(i=i % 4, body="<p>x</p>" * (i % 3)) for i in range(9)]
    vectors, classes, n = brute_classes([parse(p) for p in pages])
    expected = set()
    for vector, tokens in classes.items():
        marked = any(t is None for _, t in tokens)
        expected |= {(p, t) for p, t in tokens if t is not None and len(vector) >= 3 and (marked or 2 * len(vector) > n)}
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    parsed = stored(map_texts(df, h._parsed, h._PARSED, "html").selectExpr("*", "monotonically_increasing_id() as row"))
    found = h.classes(parsed).where("token is not null and template")
    texts = parsed.selectExpr("explode(blocks) as b").selectExpr("b.path", "b.text", "xxhash64(b.path, b.text) as token").distinct()
    assert {(r.path, r.text) for r in found.join(texts, ["path", "token"]).collect()} == expected
    assert len(expected) > 3


def test_hosts():
    assert [host_of(u) for u in ("https://A.b:8/x", "//c.d?x", None, "nothing", "ftp://u@e.f#g")] == ["a.b", "c.d", "", "", "e.f"]


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WRAPPERS = ["class='layout no-sidebar'", "class='post has-comments'", "class='header-fixed page'", "class='article-related-none'", "class='layout'", "class='sidebar'", "class='widget comments-list'"]


def test_marks_around_the_article_count_for_nothing(spark):
    rng = random.Random(1)
    word = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=n)) + f" {rng.random()}"
    page = "<body><nav><a href=x>Home</a></nav><{t} {a}><{i}><p>{x[0]}</p><p>{x[1]} <span class='ad'>Buy</span></p><div class='comments-list'><p>First! {n}</p></div></{i}></{t}><footer>Imprint</footer></body>"
    rows, want = [], {}
    for k, (inner, pages, (tag, attributes)) in enumerate(product(("article", "section"), (1, 8), [("form", "id='aspnetForm'"), *(("div", w) for w in WRAPPERS)])):
        for n in range(pages):
            x = [word(20), word(9)]
            want[100 * k + n] = "\n".join(x)
            rows.append((100 * k + n, f"http://h{k}.example.org/{n}", page.format(t=tag, a=attributes, i=inner, x=x, n=n), "", 0))
    got = frame(spark, rows)
    assert {n: got[n].text for n in want} == want


def test_paragraphs_of_few_pages_stay(spark):
    rng = random.Random(2)
    word = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=n)) + f" {rng.random()}"
    shared = "<table><tr><td>Year</td><td>Sum</td></tr></table><p>All three have this paragraph in common.</p>"
    texts = [(word(20), word(15)) for _ in range(40)]
    rows = [(n, f"http://w.example.org/{n}", f"<body><nav>Home</nav><article><p>{a}</p>{shared if n < 3 else ''}<p>{b}</p></article></body>", "", 0) for n, (a, b) in enumerate(texts)]
    got = frame(spark, rows)
    for n, (a, b) in enumerate(texts):
        assert got[n].text == "\n".join([a, "Year", "Sum", "All three have this paragraph in common.", b] if n < 3 else [a, b])


def test_deep_names_keep_their_container(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=n)) + f" {rng.random()}"
    texts = [word(30) for _ in range(9)]
    open_, close = "".join(f"<div class='flex items-center justify-between padding{k}'>" for k in range(20)), "</div>" * 20
    rows = [(n, f"http://w.example.org/{n}", f"<body><div class='promo'><p>{word(3)}</p></div><div>{word(4)}</div>{open_}<p>{x}</p><b>More</b>{close}</body>", "", 0) for n, x in enumerate(texts)]
    got = frame(spark, rows)
    assert [got[n].text for n in range(9)] == texts
    monkeypatch.setattr("sourcewell.llm.html_text.BROADCAST_BYTES", 0)
    got = frame(spark, rows)
    assert [got[n].text for n in range(9)] == texts
