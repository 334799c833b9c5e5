"""Scanners and parsers on long texts that never close what they open: time goes with the length, and nothing is too deep."""

import random
import time

import pytest

from scriptorium.functions import markdown, scan

COLORS = frozenset(["red"])
SCANNERS = {n: getattr(scan, n) for n in ("code_regions", "closes", "hold_paragraphs", "strip_marks", "mask_delimiters", "marks", "scopes", "citation_keys", "inert_zones", "wrap_environments", "parse_bib", "key_ranges", "comment_ranges", "bib_key_ranges", "footnote_definitions", "cell_runs")}
SCANNERS["decorations"] = lambda t: scan.decorations(t, COLORS)
UNITS = ["{++a ", "{~~a ~>", "{>>a ", "{#a>>", "{==a ", "==a=={", "[@k ", "[^n", "<!-- ", "$$ ", "`a ``b ", "@a{", "@misc{k, ", '@misc{k, t="', "\\begin{align}\n", "{#a}", "<a ", "\n```\n", "@a[@"]
PARSERS = {"inline": markdown.inline, "blocks": markdown.blocks, "html": markdown.to_html, "rows": markdown.run_rows}
MARKS = ["**a *b ", "{>>", "> ", "> a\n", "{++a", "`a ``b ```c ", "[^", "[@k ", "[a](<", "[a](b", "<!-- ", "<http://a ", "$", "# ", "- a\n\nb\n\n", "==a", "<table>\n", "| a |\n", "***a **b *c ", "{#a>>", "<u>"]


@pytest.mark.parametrize("name", sorted(SCANNERS))
def test_scanners_take_a_megabyte(name):
    for unit in UNITS:
        t = time.time()
        SCANNERS[name](unit * (1_000_000 // len(unit)))
        assert time.time() - t < 20, unit


@pytest.mark.parametrize("name", sorted(PARSERS))
def test_parsers_take_what_never_closes(name):
    for unit in MARKS:
        t = time.time()
        PARSERS[name](unit * (200_000 // len(unit)))
        assert time.time() - t < 20, unit


def test_depth_has_no_bound():
    n = 20_000
    runs = markdown.inline("{>>a: x " * n + "<<}" * n)
    depth, r = 1, runs[0]
    while r.inner:
        assert r.text == "x" and r.attrs == {"author": "a"}
        depth, r = depth + 1, r.inner[0]
    assert depth == n and len(markdown.flat(runs)) == n
    (b,) = markdown.blocks("> " * n + "deep")
    assert (b.type, b.level, b.text) == ("quote", n, "deep")
    stairs = markdown.blocks("\n".join("> " * k + "c" for k in range(1, 300)))
    assert [b.level for b in stairs] == list(range(1, 300))
    assert scan.closes("{>>" * n + "<<}" * n)[3] == 6 * n - 3


def test_quotes_keep_their_lines():
    got = markdown.blocks("> a\n>> b\n>> # c\n> - d\n>\n> > > e\nf")
    assert [(b.type, b.level, b.text) for b in got] == [("quote", 1, "a"), ("quote", 2, "b"), ("heading", 1, "c"), ("list_item", 0, "d"), ("quote", 3, "e"), ("paragraph", 0, "f")]


def test_authors_of_any_length():
    name = "Ä" * 200
    assert markdown.attribution(f"{name}: said") == (name, None, "said")
    assert markdown.attribution(f" {name} (2024-01-01): said: so") == (name, "2024-01-01", "said: so")
    assert markdown.attribution("no author here") == (None, None, "no author here")
    assert markdown.attribution("a (b: c") == (None, None, "a (b: c")
    assert markdown.attribution(": x") == (None, None, ": x")


def test_next_places_are_those_of_find():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices("ab{}", k=30))
        ahead = scan.Ahead(text)
        for _ in range(20):
            mark, at = r.choice(["a", "{", "ab", "zz"]), r.randrange(32)
            assert ahead.next(mark, at) == text.find(mark, at)
        assert list(scan.between("x<1>y<2", "<", ">")) == [(1, 4)]


def test_keys_at_every_place():
    text = "see [@key:1; also @b] and @bare@x, me@home.org @c[@d] @e[f"
    at = {p: k for s, e, k in scan.key_ranges(text) for p in range(s, e)}
    assert at == {p: k for p in range(len(text) + 1) if (k := scan.key_at(text, p))}
    assert {text[s + 1 : s + 1 + len(k)] for s, _, k in scan.key_ranges(text)} == {"key:1", "b", "bare", "c", "d", "e"}


def test_entries_end_where_their_braces_do():
    text = '@a{k1, t = {x "}" y}, } @b{k2, t = "{"} @c{k3, n = {@d{k4, t = {z}}}} @e{k5, t = {open'
    assert [(k, key) for k, key, _, _ in scan.parse_bib(text)] == [("a", "k1"), ("b", "k2"), ("c", "k3"), ("d", "k4")]
    n = 20_000
    many = "".join(f"@misc{{k{i},\n t = {{v{i}}}\n}}\n" for i in range(n))
    got = scan.parse_bib(many)
    assert len(got) == n and got[-1][1:3] == (f"k{n - 1}", [("t", f"v{n - 1}")])
