import random
import time

import numpy as np

from scriptorium.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string"


def page(body, more=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>{body}{more}<footer>&copy; 2020</footer></body></html>"


def text(source):
    """The text of a page that is the only one of its host."""
    p = H.Page(source)
    nodes = p.skeleton()
    tree = H.Tree(nodes, {})
    counts = np.zeros((len(tree.kids), 5), np.int64)
    counts[0, 0], counts[:, 3], counts[:, 4] = 1, tree.chars, tree.linked
    return H._text(tree, np.arange(len(tree.kids)), tree, H.wrapper_of(nodes, counts, 0.8, 2, 0.7, True), p.blocks, True)


def test_regions_that_are_not_the_article_go():
    a = "<article><header><h1>Head</h1></header><p>One &amp; two<br>three <b>four</b>.<p>Next<div class='share-buttons'>Share</div><script>var t='</p>'</script><aside>Side</aside></article>"
    more = '<div id="cookie-notice">Cookies</div><section class="comments"><p>Nice!</p></section><form><input>Mail</form><div class="ad">Buy</div>'
    assert text(page(a, more)) == "Head\nOne & two three four.\nNext"


def test_pages_without_an_article_keep_what_is_no_link_list():
    assert text("<div><h2>T</h2><p>Body text <a href=x>link</a> more words</p></div><ul><li><a href=a>A</a></li></ul>") == "T\nBody text link more words"


def test_odd_pages():
    for s in ("", "plain", "<", "<p", "<p>a<p>b</div></p>", "<!-- a", "<script>x", "a\xa0 b &#x41;&am &#0;", "<" * 500, '<a href="' * 300, "<div>" * 5000):
        text(s)
    assert text("plain  text") == "plain text" and text(None or "") == ""
    assert text("<article><p>a<p>b</article>") == "a\nb"


def brute_value(a, b):
    """Nodes in the best matching of two trees of (key, children), by trying every way."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_value(x[0], y[0]))

    return 1 + best(a[1], b[1])


def test_alignment_is_best_also_in_halves():
    rnd = random.Random(2)
    for _ in range(40):
        w = np.array([[rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))]] * 1 + [])
        w = np.array([[rnd.randint(0, 3) for _ in range(w.shape[1])] for _ in range(rnd.randint(1, 9))], float)
        n, k = w.shape
        block = lambda i, j: w[i, j]  # noqa: E731, B023
        whole, halves = H._alignment(block, 0, n, 0, k), H._alignment(block, 0, n, 0, k, cells=2)
        assert sum(w[i, j] for i, j in whole) == sum(w[i, j] for i, j in halves) == H._row(block, 0, n, 0, k)[-1] == H._row(block, 0, n, 0, k, 3, True)[-1]
        assert all(a < c and b < d for (a, b), (c, d) in zip(halves, halves[1:]))


def test_matching_against_every_way():
    rnd = random.Random(5)

    def make(depth):
        tag = rnd.choice(["div", "section"])
        return (tag, [make(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else [])

    source = lambda t: f"<{t[0]}>{''.join(map(source, t[1]))}</{t[0]}>"
    for _ in range(150):
        a, b = make(3), make(3)
        m = H.Matcher()
        ta, tb = (m.tree(H.Page(source(x)).skeleton()) for x in (a, b))
        to = m.match(ta, tb)
        want = 1 + brute_value(a, b)
        assert m.value(ta.shape[0], tb.shape[0]) == sum(x >= 0 for x in to) == want
        assert all(ta.key[i] == tb.key[j] and to[ta.parent[i]] == tb.parent[j] for i, j in enumerate(to) if i and j >= 0)


def test_deep_long_and_broken_pages_take_linear_time(spark):
    deep = "<div>" * 2000 + "<p>Words that lie deep.</p>" + "</div>" * 2000
    odd = [deep, deep.replace("lie", "lay") + "<p>more", "<div>" * 2500 + "Deeper.", '<a href="' * 12_000, "<p>x</p>" * 60_000, "<ul><li>" * 3000, "</b></i></section>" * 50_000, "<" * 100_000, "<div><p>" * 3000 + "</section>" * 3000]
    start = time.time()
    for s in odd:
        H.Page(s).skeleton()
    assert time.time() - start < 10
    rows = [(i, "http://deep.example/", s, "") for i, s in enumerate(odd)] + [(100 + i, "http://deep.example/", deep.replace("lie", f"lie {i}"), "") for i in range(6)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == "Words that lie 0 deep." and got[4].count("x") == 60_000 and len(got) == len(rows)


def neutral(i, n):
    """A page without telling tags or names: a bar of links, a notice, the story, teasers, a foot that varies."""
    rnd = random.Random(i)
    word = lambda: "".join(rnd.choice(["ther", "and", "ing", "ea", "tion"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    story = [prose(rnd.randint(15, 60)) for _ in range(n)]
    bar = "".join(f"<div class=k1><a href=/{word()}>{word()} {word()}</a></div>" for _ in range(6))
    head = prose(5)
    source = f"<html><body><div class=b1>{bar}</div><div class=b2>{prose(8)}</div><div class=b3><h1>{head}</h1><div class=b9>Read our terms before you go on.</div>{''.join(f'<div class=k2>{x}</div>' for x in story)}</div><div class=b4>{prose(6)}</div><div class=b5>All rights are ours.</div></body></html>"
    return source, "\n".join([head, *story])


def test_the_alignment_alone_finds_the_story(spark, monkeypatch):
    monkeypatch.setattr(H, "SALT_PAGES", 6)  # each host in several parts where wrappers are not broadcast
    made = {i: neutral(i, 3 + i % 9) for i in range(60)}
    rows = [(i, f"http://{'abc'[i % 3]}.example/{i}", s, "") for i, (s, _) in made.items()]
    for kw in ({"names": False}, {}, {"max_broadcast": 0}):
        got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA), **kw).collect()}
        assert got == {i: t for i, (_, t) in made.items()}
    one = H.main_text(spark.createDataFrame(rows[:1], SCHEMA)).collect()[0].text  # nothing to align with: the constant line stays
    assert one == made[0][1].replace("\n", "\nRead our terms before you go on.\n", 1)


def test_two_layouts_of_a_host_and_pages_without_text(spark):
    def other(i):
        return f"<html><body><table><tr><td>Menu of things</td><td><p>Other story {i} in a table, with words enough to be one.</p><p>It goes on, {i * 3}.</p></td></tr></table><div>Old foot</div></body></html>"

    made = {i: neutral(i, 4) for i in range(20)}
    rows = [(i, "http://x.example/", s, "") for i, (s, _) in made.items()] + [(100 + i, "http://x.example/", other(i), "") for i in range(20)]
    rows += [(200 + i, "http://x.example/", x, "") for i, x in enumerate(["", None, "<html><body></body></html>"] * 10)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == t for i, (_, t) in made.items())
    assert all(got[100 + i] == f"Other story {i} in a table, with words enough to be one.\nIt goes on, {i * 3}." for i in range(20))
    assert all(got[200 + i] == "" for i in range(30))
    assert H.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_constant_nodes_of_a_host_go_and_copies_do_not(spark):
    def body(i):
        return f"<div><p>Read our terms before you go on.</p><p>Story {i} has words of its own, number {i * 7}.</p><p>And a second part {i * 13} that differs.</p></div>"

    rows = [(i, "http://a.example/x", page(body(i)), "") for i in range(12)]
    rows += [(100 + i, "http://b.example/", page("<div><p>One story in many copies.</p><p>All of it the same.</p></div>"), "") for i in range(12)]
    rows += [(200, None, None, ""), (201, "http://[bad", "<p>x</p>", ""), (None, "http://a.example/", "<p>y</p>", "")]
    got = {r.page_id: r for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"Story {i} has words of its own, number {i * 7}.\nAnd a second part {i * 13} that differs.", got[i].text
        assert got[100 + i].text == "One story in many copies.\nAll of it the same."
    assert got[200].text == "" and got[200].n_chars == 0 and got[201].text == "x" and got[None].text == "y"
