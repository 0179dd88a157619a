import html
import random
import re
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from spectraframe.llm import template_html as T

SF = "/root/testdata/sf0.01"


def page(i, body, wrap="article"):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/x{i}">Item {i}</a><li>Two</ul></nav>
<div class="cookie-notice">We use cookies {i}</div><div id="ad-top" class="advert">Buy {i}</div>
<{wrap}>{body}<p class="share">Share this</p></{wrap.split()[0]}>
<aside>Related {i}</aside><section class="comments"><article class="comment"><p>First {i}!</p></article></section>
<form action="/s"><label>Search</label><input name=q><button>Go</button></form><script>var a = "</p><p>no</p>";</script>
<footer>&copy; 2024 Site</footer></body></html>"""


def test_leaves_the_article():
    body = "<h1>Caf&eacute; &amp; bar</h1><p>One\n  two<b>bold</b> &nbsp; end<br>after<p>Next &#8364;5 <!-- x --> ok<ul><li>a<li>b</ul><p>Last &lt;tag&gt;"
    got = T.extract([page(1, body)])
    assert got == ["Café & bar\nOne twobold end after\nNext €5 ok\na\nb\nLast <tag>"]


def test_template_words_go_and_repeated_article_words_stay():
    pages = [page(i, f"<p>Text number {i}.</p><p>Subscribe for more news</p><p>{'Shared line' if i % 2 else 'own ' + str(i)}</p>") for i in range(12)]
    for i, text in enumerate(T.extract(pages)):
        assert text == f"Text number {i}.\n" + ("Shared line" if i % 2 else f"own {i}")


def test_without_a_main_region():
    pages = [page(i, f"<p>Long running text of page {i} that goes on for a while.</p><p>More of {i}.</p>", "div class=content") for i in range(8)]
    assert T.extract(pages) == [f"Long running text of page {i} that goes on for a while.\nMore of {i}." for i in range(8)]


def test_odd_pages():
    got = T.extract(["plain words"])
    assert got == ["plain words"]
    assert T.extract(["<article><p>cut &am"]) == ["cut &am"]
    assert T.extract(["<article><p a=\"x>y\" b='>'>in</p></article>"]) == ["in"]
    assert len(T.extract(["<div>" * 3000 + "deep"])[0]) == 4


def test_classes_keep_order_and_nest():
    pages = [["a", "b", "x", "c"], ["a", "b", "y", "y", "c"], ["a", "b", "c"]]
    assert T.Template(pages).tokens() == {"a", "b", "c"}
    # b and c change places: the order of most pages counts.
    assert T.Template([["a", "b", "c"], ["a", "c", "b"], ["a", "b", "c"]]).tokens() >= {"a"}
    # Repetitions of u v nest between a and z; the broken class p q does not count.
    pages = [["a", "u", "v", "u", "v", "z", "p", "q"], ["a", "u", "v", "u", "v", "z", "p", "q"], ["a", "u", "v", "u", "v", "z", "q", "p"]]
    assert {"a", "u", "v", "z"} <= T.Template(pages).tokens()
    assert T.Template([["a"]]).tokens() == set()


def truth(h):
    m = re.search(r"<article>(.*?)</article>", h or "", re.S)
    parts = re.split(r"</?(?:p|h1)[^>]*>", m[1] if m else "")
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(x for x in out if x)


def test_all_pages_of_a_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    rows = T.main_text(pages.selectExpr("*", "1 AS host", "'x' AS salt")).collect()
    assert {r.page_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_hot_hosts_nulls_and_empty(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 10)
    rows = [(i, f"http://Host.example/{i}", page(i, f"<p>Text {i}</p>")) for i in range(95)] + [(None, None, None), (3, "http://host.example/3", page(3, "<p>Text 3</p>")), (200, "no url", "<article>y</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id is None, r.page_id or 0, r.text) for r in T.main_text(df).collect())
    assert got == sorted([(False, i, f"Text {i}") for i in range(95)] + [(True, 0, ""), (False, 3, "Text 3"), (False, 200, "y")])
    assert T.main_text(df.limit(0)).count() == 0


def plain_site(n, seed=1):
    """Pages without any tag or name that tells what a part is, and the texts of their articles."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    para = lambda k: " ".join(word() for _ in range(k)) + "."
    links = [word() for _ in range(5)]
    pages, texts = [], []
    for i in range(n):
        own = [para(6), *(para(rnd.randrange(10, 60)) for _ in range(rnd.randrange(1, 6)))]
        teasers = "".join(f"<div><a href='/{word()}'>{para(4)}</a><span>{para(rnd.randrange(1, 4))}</span></div>" for _ in range(rnd.randrange(2, 5)))
        body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{x}</p>" for x in own[1:2]) + "<div class=qa>Read all of our letters every day</div>" + "".join(f"<p>{x}</p>" for x in own[2:])
        pages.append(
            f"<html><body><div class=xa><span>Some Site</span>{''.join(f'<div>{x}</div>' for x in links)}</div><div class=xb><div class=xc>{body}</div>"
            f"<div class=xd>{teasers}</div></div><div class=xe><p>Printed by {word()} and sons in the year of {i}.</p><p>All words are ours.</p></div></body></html>"
        )
        texts.append("\n".join(own))
    return pages, texts


def test_slots_of_pages_that_mark_nothing():
    for n in (2, 4, 12, 60):
        pages, texts = plain_site(n, n)
        assert T.extract(pages) == texts


def test_the_template_decides(monkeypatch):
    pages, texts = plain_site(12)

    class Nothing(T.Template):
        def __init__(self, pages):
            super().__init__([[] for _ in pages])

        def slot(self, page, at):
            return -1, 0

    assert T.extract(pages) == texts
    monkeypatch.setattr(T, "Template", Nothing)
    without = T.extract(pages)
    assert all(a != b for a, b in zip(without, texts)) and all("Some Site" in a for a in without)


def test_two_layouts_on_a_host():
    a, texts_a = plain_site(10, 3)
    b, texts_b = plain_site(10, 4)
    b = [x.replace("class=x", "class=y").replace("Some Site", "Other Site") for x in b]
    pages = [x for both in zip(a, b) for x in both]
    got = T.extract(pages)
    assert got[::2] == texts_a and got[1::2] == texts_b


def test_names_of_an_article():
    body = "<article class='notice-of-the-search research'><div class='market-share'><p>In</p></div><div class='share-buttons'>Out</div><div id=newsletter>Out</div></article>"
    assert T.extract([body]) == ["In"]


def test_deep_nesting_and_many_open_tags():
    t = time.time()
    assert T.extract(["<div>" * 16_000 + "deep"] * 3) == ["deep"] * 3
    assert T.extract(["<b>" * 8_000 + "x" + "</i>" * 8_000]) == ["x"]
    assert T.extract(["<ul>" + "<li>y" * 8_000])[0].count("y") == 8_000
    assert time.time() - t < 20


def brute_force(pages):
    """Tokens of the template by the definition, all pairs of repetitions compared."""
    n, vectors = len(pages), defaultdict(list)
    for t in {t for p in pages for t in p}:
        v = tuple((i, p.count(t)) for i, p in enumerate(pages) if t in p)
        if len(v) >= max(T.CLASS_PAGES, T.CLASS_SHARE * n):
            vectors[v].append(t)
    accepted, out = [], set()
    at = lambda t, i: [k for k, x in enumerate(pages[i]) if x == t]
    key = lambda x: (-len(x[0]), -len(x[1]), sum(c for _, c in x[0]), x[0][0][0], min(at(t, x[0][0][0])[0] for t in x[1]))
    for v, tokens in sorted(vectors.items(), key=key):
        tokens.sort(key=lambda t: at(t, v[0][0])[0])
        spans, good = [], True
        for i, c in v:
            rows = [[at(t, i)[k] for t in tokens] for k in range(c)]
            flat = [x for r in rows for x in r]
            good &= flat == sorted(flat)
            if not good and all(k == 1 for _, k in v):
                return None  # such a class drops tokens that change places; see the test above
            spans += [(i, r[0], r[-1]) for r in rows]
        if good and all(i != j or not (s < a <= e < b or a < s <= b < e) for i, s, e in spans for j, a, b in accepted):
            accepted += spans
            out |= set(tokens)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=9), min_size=2, max_size=5))
def test_template_equals_brute_force(pages):
    want = brute_force(pages)
    assert want is None or T.Template(pages).tokens() == want
    frame = T.Template(pages)
    for c in frame.classes:  # valid: in order everywhere
        for i, rows in c.rows.items():
            flat = [x for r in rows for x in r]
            assert flat == sorted(flat) and [pages[i][x] for x in flat] == c.tokens * len(rows)
    spans = [(i, r[0], r[-1]) for c in frame.classes for i, rows in c.rows.items() for r in rows]
    assert not any(i == j and s < a <= e < b for i, s, e in spans for j, a, b in spans)


def test_the_order_of_pages_is_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 7)
    pages, texts = plain_site(80, 9)
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    schema = "page_id long, url string, html string"
    one = {r.page_id: r.text for r in T.main_text(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    random.Random(2).shuffle(rows)
    other = {r.page_id: r.text for r in T.main_text(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    assert one == other and sum(one[i] == t for i, t in enumerate(texts)) >= 76
