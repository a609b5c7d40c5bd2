"""Main text: structure, the suffix array against brute force, odd pages."""

import numpy as np
import pytest

from stationlake.llm import pages

CHROME = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>gone</p> -->
<div class="ad">Buy this</div><aside>Side</aside>%s<div id="cookie-notice">We use cookies</div><section class="comments"><p>Reader says</p></section>
<form><label>Mail</label><input name="m"></form><footer>&copy; site</footer></body></html>"""


def main_text(html):
    return "\n".join(t for kind, t in pages.blocks(html) if kind == pages.MAIN)


@pytest.mark.parametrize(
    "body,expected",
    [
        ("<article><h1>A &amp;  B</h1><p>one\n two<br>three</p><p>caf&eacute;&nbsp;&#8364;</p></article>", "A & B\none two three\ncafé €"),
        ("<article><p><b>bold <i>x</i><br><p>next<p>last</article>", "bold x\nnext\nlast"),
        ("<main><div>in <span>main</span></div><div class='share'>tweet</div></main>", "in main"),
        ("<article><header><h1>Head</h1></header><p>a < b &lt;c&gt; &am</p><footer>foot</footer></article>", "Head\na < b <c> &am"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre> k  l </pre></article>", "x\ny\n1\n2\nk l"),
        ("<ARTICLE><P CLASS=lead>Up</P><SCRIPT>no()</SCRIPT><p>be<wbr>fore</p><p hidden>hid</p></ARTICLE>", "Up\nbefore"),
        ("<article><p>un<em>b</em>roken</p><aside>note</aside><div class='comment'><p>c</p></div>tail</article>", "unbroken\ntail"),
    ],
)
def test_marked_articles(body, expected):
    assert main_text(CHROME % body) == expected


@pytest.mark.parametrize(
    "body,expected",
    [
        ("<div class='layout no-sidebar'><article class='post has-comments'><p>own text</p></article></div>", "own text"),
        ("<form><div><article><p>own</p><form>mail</form></article></div><p>x</p></form>", "own"),
        ("<main><form><article><p>own</p></article></form><p>x</p></main>", "own"),
        ("<div class='social'><article id='comments'><p>own text of it</p><div class='share'>tweet</div></article></div>", "own text of it"),
        ("<article><p>own</p><div class='post-comments'>c</div><div class='share-bar'>s</div></article><div class='related'><article>a longer teaser</article></div>", "own"),
    ],
)
def test_wrappers_do_not_hide_the_article(body, expected):
    assert main_text(f"<html><body><nav>Home</nav>{body}<footer>f</footer></body></html>") == expected


def test_an_article_among_related_ones_is_not_the_page():
    html = "<body><div><p>the long and own text of this page</p></div><div class='related'><article>teaser</article></div></body>"
    assert pages.blocks(html) == [(pages.LOOSE, "the long and own text of this page"), (pages.CHROME, "teaser")]


def rows(spark, listed, **options):
    df = spark.createDataFrame(listed, "page_id long, url string, html string, text int, host string")
    out = pages.extract(df, **options)
    assert out.columns == ["page_id", "url", "html", "host", "text"]
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    line = "subscribe to our daily letter and never miss a story again"
    body = lambda i: f"<html><body><div><p>{line}</p><p>{i} unique words {i} of this page {i} stand here {i}</p><p>{line} x{i}</p></div></body></html>"
    listed = [(i, "http://A.example:80/p%d" % i, body(i), 1, "h") for i in range(4)]
    listed += [(9, "https://b.example/", body(9), 1, "h")]
    got = rows(spark, listed)
    for i in range(4):
        assert got[i] == f"{i} unique words {i} of this page {i} stand here {i}\nx{i}"
    assert got[9] == f"{line}\n9 unique words 9 of this page 9 stand here 9\n{line} x9"
    # A marked page of the host is evidence against the others.
    listed = [(1, "http://c/1", body(1), 1, "h"), (2, "http://c/2", f"<article>own text</article><footer>{line}</footer>", 1, "h")]
    got = rows(spark, listed)
    assert got == {1: "1 unique words 1 of this page 1 stand here 1\nx1", 2: "own text"}
    # Equal pages are one page.
    assert rows(spark, [(i, "http://d/", body(0), 1, "h") for i in range(3)])[1].startswith(line)


def test_coverage_equals_brute_force_for_any_slice(spark):
    draw = np.random.default_rng(4)
    texts = [" ".join(draw.choice(["a", "b"], int(draw.integers(0, 40)))) for _ in range(25)]
    listed = [(i, "http://e/", f"<body><p>{t}</p></body>", 1, "h") for i, t in enumerate(texts)]
    depth, expected = 8, {}
    distinct = sorted(set(texts))
    grams = {}
    for t in distinct:
        w = t.split()
        for k in range(len(w) - depth + 1):
            grams.setdefault(tuple(w[k : k + depth]), set()).add(t)
    for i, t in enumerate(texts):
        w = t.split()
        gone = {k + j for k in range(len(w) - depth + 1) if len(grams[tuple(w[k : k + depth])]) > 1 for j in range(depth)}
        expected[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    for size in (1 << 20, 60):
        assert rows(spark, listed, slice_tokens=size) == expected


def test_quotations_variants_and_pages_without_host_stay(spark):
    line = "subscribe to our daily letter and never miss a story again"
    quote = "to be or not to be that is the question of the day"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(100))
    body = lambda i, more="": f"<body><p>{line}</p><p>{own(i)}</p>{more}</body>"
    listed = [(i, "http://a/%d" % i, body(i, f"<p>{quote}</p>" if i < 2 else ""), 1, "h") for i in range(60)]
    listed += [(100, "http://b/1", f"<body><p>{own(1)}</p><p>print</p></body>", 1, "h"), (101, "http://b/2", f"<body><p>{own(1)}</p><p>mobile</p></body>", 1, "h")]
    listed += [(200 + i, "nowhere", body(300 + i), 1, "h") for i in range(3)]
    for size in (1 << 20, 300):
        got = rows(spark, listed, slice_tokens=size)
        assert [got[i] for i in range(60)] == [own(i) + f"\n{quote}" * (i < 2) for i in range(60)]
        assert got[100] == own(1) + "\nprint" and got[101] == own(1) + "\nmobile"
        assert all(got[200 + i] == f"{line}\n{own(300 + i)}" for i in range(3))


def test_articles_lose_the_frame_of_their_host(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    alert = "please renew your membership before the end of this month today"
    quote = "to be or not to be that is the question of the day"
    box = lambda i: f"<div class='alert'>{alert}</div>" if i else ""
    body = lambda i: f"<body><nav>Home</nav><article><h1>Head {i}</h1>{box(i)}<p>{own(i)}</p>{f'<p>{quote}</p>' if i < 12 else ''}</article></body>"
    text = lambda i: f"Head {i}\n{own(i)}" + f"\n{quote}" * (i < 12)
    listed = [(i, "http://a/%d" % i, body(i), 1, "h") for i in range(20)]
    listed += [(100 + i, "http://a/", body(19), 1, "h") for i in range(3)]  # copies are one page
    listed += [(200 + i, "http://b/", body(i), 1, "h") for i in range(1, 5)]  # too few articles
    # An article that is frame but for a few words is a variant of others and stays.
    listed += [(300 + i, "http://c/", f"<article><p>{own(0)}</p><p>{alert}</p><p>v{i}</p></article>", 1, "h") for i in range(6)]
    # The articles' frame, and no other repeat: what other pages say outside their articles is no evidence.
    listed += [(400 + i, "http://d/", f"<article><p>{own(i)}</p></article><p>{quote}</p>" if i else f"<article><p>{quote}</p><p>x</p></article>", 1, "h") for i in range(9)]
    for size in (1 << 20, 2000, 200):
        got = rows(spark, listed, slice_tokens=size)
        assert [got[i] for i in range(20)] == [text(i) for i in range(20)]
        assert all(got[100 + i] == text(19) for i in range(3))
        assert all(got[200 + i] == text(i).replace("\n", f"\n{alert}\n", 1) for i in range(1, 5))
        assert all(got[300 + i] == f"{own(0)}\n{alert}\nv{i}" for i in range(6))
        assert got[400] == f"{quote}\nx" and got[401] == own(1)


def test_articles_are_evidence_against_unmarked_pages(spark):
    passage = "to be or not to be that is the question of the day"
    listed = [(1, "http://a/1", f"<article><p>first words {passage}</p></article>", 1, "h"), (2, "http://a/2", f"<body><p>{passage}</p><p>other words</p></body>", 1, "h")]
    for size in (1 << 20, 10):
        assert rows(spark, listed, slice_tokens=size) == {1: f"first words {passage}", 2: "other words"}


def test_articles_and_unmarked_pages_equal_brute_force_for_any_slice(spark):
    draw, depth = np.random.default_rng(6), 8
    frames = [" ".join(draw.choice(["c", "d", "e"], 9)) for _ in range(3)]
    some = lambda n: " ".join(draw.choice(["a", "b", "f"], int(draw.integers(1, n))))
    made = []
    for i in range(30):
        listed = [some(14) for _ in range(int(draw.integers(2, 5)))] + [f for k, f in enumerate(frames) if draw.random() < (1, 0.95, 0.6)[k]]
        draw.shuffle(listed)
        made.append((i % 5 > 0, listed, [some(14)]))  # whether an article is marked, its blocks (or the page's), and what follows
    made.append(made[1])
    page = lambda m, a, b: "<body>" + ("<article>%s</article>" if m else "%s") % "".join(f"<p>{t}</p>" for t in a) + "".join(f"<p>{t}</p>" for t in b) + "</body>"
    parts = lambda m, a, b: (" ".join(a if m else []).split(), " ".join(b if m else a + b).split())
    distinct = [parts(*p) for p in made[:30]]
    grams = lambda w: {tuple(w[k : k + depth]) for k in range(len(w) - depth + 1)}
    articles = sum(p[0] for p in made[:30])
    held = lambda g, of: sum(g in x for x in of)
    whole, own = [grams(a) | grams(b) for a, b in distinct], [grams(a) for a, _ in distinct]
    gone = lambda w, goes: {k + j for k in range(len(w) - depth + 1) if goes(tuple(w[k : k + depth])) for j in range(depth)}
    expected, framed = {}, 0
    for i, (m, a, b) in enumerate(made):
        w, rest = parts(m, a, b)
        if m:
            out, at, kept = gone(w, lambda g: held(g, own) >= max(5, np.ceil(0.9 * articles))), 0, []
            for t in a:
                n = len(t.split())
                if not set(range(at, at + n)) <= out:
                    kept.append(t)
                at += n
            framed += len(kept) < len(a)
            expected[i] = "\n".join(kept)
            assert len(" ".join(kept).split()) > 0.1 * len(w)
        else:
            out, at, lines = gone(rest, lambda g: held(g, whole) >= 2), 0, []
            for t in a + b:
                n = len(t.split())
                lines.append(" ".join(x for k, x in enumerate(t.split(), at) if k not in out))
                at += n
            expected[i] = "\n".join(x for x in lines if x)
    assert framed > 10
    listed = [(i, "http://e/", page(*p), 1, "h") for i, p in enumerate(made)]
    for size in (1 << 20, 150):
        assert rows(spark, listed, slice_tokens=size) == expected


def test_suffix_ranks_equal_sorting():
    tokens = np.random.default_rng(2).integers(0, 3, 200)
    ranks = pages.suffix_ranks(tokens, 4)
    beginnings = [tuple(tokens[i : i + 4]) for i in range(200)]
    order = {b: i for i, b in enumerate(sorted(set(beginnings)))}
    assert [r - 1 for r in ranks] == [order[b] for b in beginnings]


def test_odd_pages(spark):
    listed = [
        (1, None, None, 1, "h"), (2, "", "", 1, "h"), (3, "x", "<", 1, "h"), (4, "x", "plain text", 1, "h"), (5, "http://y/", "<article><p>cut off", 1, "h"),
        (6, "http://y/", "<article>" + "<p>word</p>" * 20_000, 1, "h"), (7, "http://y/", "</p></div><p>a</p></b>", 1, "h"), (8, "x", "<script>never closed", 1, "h"),
    ]
    got = rows(spark, listed)
    assert [got[i] for i in (1, 2, 3, 4, 5, 7, 8)] == ["", "", "<", "plain text", "cut off", "a", ""]
    assert got[6] == "\n".join(["word"] * 20_000)
    assert rows(spark, []) == {}


def test_given_pages_hold_their_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.extract(df).collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        inner = inner.replace("<p>", "\n").replace("</p>", "\n").replace("</h1>", "\n")
        for tag in ("<h1>", "<b>", "<br>"):
            inner = inner.replace(tag, " ")
        import html as h
        assert r["text"] == "\n".join(x for x in (" ".join(h.unescape(line).split()) for line in inner.split("\n")) if x)
