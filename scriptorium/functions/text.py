"""Scalar transforms of manuscript text as Column expressions (all inside codegen or built-in lambdas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript-like engines see it; the same class in Java's and RE2's syntax.
WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Names of marks and what stands before and after the marked text.
WRAPS = {
    "bold": ("**", "**"),
    "italic": ("_", "_"),
    "bold_italic": ("***", "***"),
    "strikethrough": ("~~", "~~"),
    "underline": ("<u>", "</u>"),
    "code": ("`", "`"),
    "highlight": ("==", "=="),
    "addition": ("{++", "++}"),
    "deletion": ("{--", "--}"),
    "substitution": ("{~~", "~>~~}"),
    "comment": ("{>>", "<<}"),
}


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def blank(c: Column) -> Column:
    return trim_ws(c) == ""


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _author(author: Column | None) -> Column:
    return F.lit("") if author is None else F.when(F.coalesce(author, F.lit("")) == "", "").otherwise(F.concat(author, F.lit(": ")))


def wrap(c: Column, mark: str, author: Column | None = None) -> Column:
    """Text between the two halves of a mark; comments may carry an author."""
    before, after = WRAPS[mark]
    return F.concat(F.lit(before), _author(author) if mark == "comment" else F.lit(""), c, F.lit(after))


def wrap_color(c: Column, color: Column) -> Column:
    return F.concat(F.lit("=="), c, F.lit("=={"), color, F.lit("}"))


def with_comment(c: Column, mark: str, author: Column | None = None) -> Column:
    """``struct(new_text, cursor)``: marked text followed by an empty comment, the cursor inside it."""
    marked = F.concat(F.lit("{=="), c, F.lit("==}")) if mark == "highlight" else wrap(c, mark)
    head = F.concat(marked, F.lit("{>>"), _author(author))
    return F.struct(F.concat(head, F.lit("<<}")).alias("new_text"), F.length(head).alias("cursor"))


def with_comment_id(c: Column, comment_id: Column, author: Column | None = None) -> Column:
    """As ``with_comment``, the range and the comment tied by an identifier."""
    head = F.concat(F.lit("{#"), comment_id, F.lit("}"), c, F.lit("{/"), comment_id, F.lit("}{#"), comment_id, F.lit(">>"), _author(author))
    return F.struct(F.concat(head, F.lit("<<}")).alias("new_text"), F.length(head).alias("cursor"))


def code_block(c: Column) -> Column:
    return F.concat(F.lit("```\n"), c, F.lit("\n```"))


def prefix_lines(c: Column, prefix: str, skip_if_present: bool = False) -> Column:
    """Prefix each line that is not blank."""

    def one(x: Column) -> Column:
        keep = blank(x)
        if skip_if_present:
            keep = keep | F.startswith(F.regexp_replace(x, rf"^{WS}+", ""), F.lit(prefix.strip()))
        return F.when(keep, x).otherwise(F.concat(F.lit(prefix), x))

    return F.array_join(F.transform(lines(c), one), "\n")


def number_lines(c: Column) -> Column:
    """Number the lines that are not blank, from 1."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        n = acc.n + F.when(blank(x), 0).otherwise(1)
        return F.struct(n.alias("n"), F.array_append(acc.out, F.when(blank(x), x).otherwise(F.concat(n.cast("string"), F.lit(". "), x))).alias("out"))

    return F.array_join(F.aggregate(lines(c), zero, add, lambda a: a.out), "\n")


def heading(c: Column, level: int) -> Column:
    """Every line a heading of ``level``, in place of the heading that it may be."""
    return F.array_join(F.transform(lines(c), lambda x: F.concat(F.lit("#" * level + " "), F.regexp_replace(x, rf"^#+{WS}", ""))), "\n")


def link(c: Column) -> Column:
    """``struct(new_text, cursor)``: a link of text, of an address, or an empty one."""
    address = F.lower(trim_ws(c)).rlike("^https?://")
    text = F.when(blank(c), "[]()").when(address, F.concat(F.lit("[]("), c, F.lit(")"))).otherwise(F.concat(F.lit("["), c, F.lit("]()")))
    return F.struct(text.alias("new_text"), F.when(blank(c) | address, 1).otherwise(F.length(c) + 3).alias("cursor"))


def is_table_row(line: Column) -> Column:
    t = trim_ws(line)
    return (F.length(t) >= 2) & F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|"))


def row_cells(line: Column) -> Column:
    parts = F.split(trim_ws(line), r"\|", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), trim_ws)


def is_separator_row(line: Column) -> Column:
    inner = F.split(F.regexp_replace(trim_ws(line), r"^\||\|$", ""), r"\|", -1)
    ok = F.forall(inner, lambda x: (F.length(F.regexp_replace(x, "[^:-]", "")) >= 3) & x.contains("-"))
    return is_table_row(line) & trim_ws(line).rlike(rf"^\|(?:{WS}|[:|-])+\|$") & ok


def alignment(cell: Column) -> Column:
    first, last = F.startswith(cell, F.lit(":")), F.endswith(cell, F.lit(":"))
    return F.when(first & last, "center").when(first, "left").when(last, "right").otherwise("default")


def table_rows(c: Column) -> Column:
    """Rows of a pipe table as ``array<struct<cells, sep>>``; null where some line is no row, or there is none."""
    rows = F.filter(F.transform(lines(c), trim_ws), lambda x: x != "")
    parsed = F.transform(rows, lambda x: F.struct(row_cells(x).alias("cells"), is_separator_row(x).alias("sep")))
    return F.when((F.size(rows) > 0) & F.forall(rows, is_table_row), parsed)


def table_widths(rows: Column) -> Column:
    """Width of each column: the longest cell of the rows that are not separators."""
    n = F.array_max(F.transform(rows, lambda r: F.size(r.cells)))
    content = F.filter(rows, lambda r: ~r.sep)
    width = lambda i: F.coalesce(F.array_max(F.transform(content, lambda r: F.length(F.get(r.cells, i - 1)))), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), width)).otherwise(F.array().cast("array<int>"))


def pad_end(c: Column, width: Column) -> Column:
    return F.rpad(c, F.greatest(width, F.length(c)), " ")


def reflow_table(c: Column) -> Column:
    """A pipe table with columns of even width; any other text as it is."""
    rows, widths = table_rows(c), table_widths(table_rows(c))
    aligns = F.transform(F.get(F.filter(rows, lambda r: r.sep), F.lit(0)).cells, alignment)

    def mark(w: Column, i: Column) -> Column:
        w = F.greatest(w, F.lit(3))
        a = F.coalesce(F.get(aligns, i), F.lit("default"))
        dashes = lambda n: F.repeat(F.lit("-"), n)
        return F.when(a == "left", F.concat(F.lit(":"), dashes(w - 1))).when(a == "right", F.concat(dashes(w - 1), F.lit(":"))).when(a == "center", F.concat(F.lit(":"), dashes(F.greatest(w - 2, F.lit(1))), F.lit(":"))).otherwise(dashes(w))

    content = lambda r: F.array_join(F.transform(r.cells, lambda x, i: pad_end(x, F.coalesce(F.get(widths, i), F.lit(0)))), " | ")
    line = lambda r: F.concat(F.lit("| "), F.when(r.sep, F.array_join(F.transform(widths, mark), " | ")).otherwise(content(r)), F.lit(" |"))
    return F.coalesce(F.array_join(F.transform(rows, line), "\n"), c)


def longest_backticks(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))


def render_run(c: Column, fmt: dict[str, Column], color: Column | None = None) -> Column:
    """A run in Markdown. ``fmt`` has boolean columns; code stands alone, then sup or sub, highlight, u, ~~, *, **."""
    off = F.lit(False)
    f = lambda k: F.coalesce(fmt.get(k, off), off)
    fence = F.repeat(F.lit("`"), longest_backticks(c) + 1)
    spaces = F.startswith(c, F.lit(" ")) & F.endswith(c, F.lit(" ")) & ~blank(c)
    pad = F.when(F.startswith(c, F.lit("`")) | F.endswith(c, F.lit("`")) | spaces, " ").otherwise("")
    code = F.concat(fence, pad, c, pad, fence)
    out = F.when(f("superscript"), F.concat(F.lit("<sup>"), c, F.lit("</sup>"))).when(f("subscript"), F.concat(F.lit("<sub>"), c, F.lit("</sub>"))).otherwise(c)
    plain = F.concat(F.lit("=="), out, F.lit("=="))
    colored = plain if color is None else F.when(color.isNotNull() & (color != "yellow"), wrap_color(out, color)).otherwise(plain)
    out = F.when(f("highlight"), colored).otherwise(out)
    for k, a, b in (("underline", "<u>", "</u>"), ("strikethrough", "~~", "~~"), ("italic", "*", "*"), ("bold", "**", "**")):
        out = F.when(f(k), F.concat(F.lit(a), out, F.lit(b))).otherwise(out)
    return F.when(f("code"), code).otherwise(out)


def href(c: Column) -> Column:
    return F.when(c.rlike(rf"[()\[\]]|{WS}"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(c)


def escape_bibtex(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}~^\\])", r"\\$1")


def unescape_bibtex(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([&%$#_{}~^\\])", "$1")


def escape_bibtex_once(c: Column) -> Column:
    """Escaping that leaves what is escaped already as it is."""
    return escape_bibtex(unescape_bibtex(c))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _numeric_references(c: Column, pattern: str, base: int) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    gaps = F.split(c, pattern, -1)
    code = lambda x: F.conv(x, base, 10).cast("long")
    # chr() counts modulo 256, so characters come from UTF-32; numbers that are no characters stand as U+FFFD. The
    # mark in front is taken for the byte order, so that U+FEFF itself stays.
    char = lambda n: F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), 0xFFFD).otherwise(n)), 8, "0"))), "UTF-32")
    decoded = F.transform(F.transform(found, code), char)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(F.when(i > 0, F.coalesce(F.get(decoded, i - 1), F.lit(""))).otherwise(""), g)), "")


def decode_entities(c: Column, nbsp: str = " ") -> Column:
    """Numeric and the few named references, ``&amp;`` last."""
    c = _numeric_references(c, r"&#(\d{1,7});", 10)
    c = _numeric_references(c, r"&#x([0-9a-fA-F]{1,6});", 16)
    for a, b in (("&nbsp;", nbsp), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    return decode_entities(F.regexp_replace(c, "<[^>]+>", ""))


def strip_outer_braces(c: Column) -> Column:
    """Without the outer braces if they are one pair around the whole."""
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    zero = F.struct(F.lit(1).alias("depth"), F.lit(True).alias("ok"))
    step = lambda a, x: F.struct((a.depth + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("depth"), (a.ok & ~((x == "}") & (a.depth == 1))).alias("ok"))
    whole = F.aggregate(F.split(inner, ""), zero, step, lambda a: a.ok)
    return F.when((F.length(c) >= 2) & F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}")) & whole, inner).otherwise(c)


def word_count(c: Column) -> Column:
    """Words between white space, without front matter; they are counted as they are found, not gathered."""
    body = F.regexp_replace(c, r"\A---\r?\n(?s:.*?)\r?\n---\r?\n?", "")
    return F.regexp_count(body, F.lit(f"[^{WS[1:-1]}]+"))


def citation_key(surname: Column, year: Column, title: Column, form: str = "authorYearTitle") -> Column:
    clean = F.lower(F.regexp_replace(surname, "[^a-zA-Z0-9]", ""))
    digits = F.regexp_replace(year, "[^0-9]", "")
    if form == "numeric":
        return F.lit("")
    if form == "authorYear":
        return F.concat(clean, digits)
    words = F.regexp_extract_all(F.lower(title), F.lit(r"\b[a-zA-Z]+\b"), F.lit(0))
    first = F.get(F.filter(words, lambda w: ~w.isin("the", "a", "an")), F.lit(0))
    return F.concat(clean, digits, F.coalesce(first, F.lit("unknown")))


def item_identity(doi: Column, title: Column, year: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), F.nullif(doi, F.lit(""))), F.concat(F.coalesce(title, F.lit("")), F.lit("::"), F.coalesce(year, F.lit(""))))


def surname(literal: Column, family: Column, publisher: Column, journal: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (literal, family, publisher, journal)], F.lit("unknown"))


def clean_locator(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\];@]", "")


def parse_locator(c: Column) -> Column:
    """``struct(locator, label)``; ``p.`` and ``pp.`` go."""
    t = trim_ws(c)
    m = F.regexp_extract(t, rf"^pp?\.{WS}*(.+)$", 1)
    return F.struct(F.when(m != "", m).otherwise(t).alias("locator"), F.lit("page").alias("label"))


#: Kinds of entries in either scheme.
BIBTEX_TO_CSL = {"article": "article-journal", "book": "book", "inproceedings": "paper-conference", "incollection": "chapter", "inbook": "chapter", "phdthesis": "thesis", "mastersthesis": "thesis", "techreport": "report", "misc": "article"}
CSL_TO_BIBTEX = {"article-journal": "article", "article-magazine": "article", "article-newspaper": "article", "book": "book", "chapter": "incollection", "paper-conference": "inproceedings", "report": "techreport"}


#: Kinds of notes and the numbers that a reference manager has for them.
NOTE_NUMBERS = {"in-text": 0, "footnotes": 1, "endnotes": 2, "0": 0, "1": 1, "2": 2}


def _by(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in table.items():
        out = out.when(c == k, v)
    return out.otherwise(default)


def csl_type(bibtex: Column) -> Column:
    return _by(F.lower(bibtex), BIBTEX_TO_CSL, "article")


def bibtex_type(csl: Column, genre: Column | None = None) -> Column:
    genre = F.lit("") if genre is None else F.coalesce(genre, F.lit(""))
    return F.when(csl == "thesis", F.when(F.lower(genre).contains("master"), "mastersthesis").otherwise("phdthesis")).otherwise(_by(csl, CSL_TO_BIBTEX, "misc"))


def split_authors(c: Column) -> Column:
    """Names between `` and `` outside braces."""
    # A separator inside braces has more open than closed braces before it: parts up to there are joined again.
    parts = F.split(c, " and ", -1)
    depth = lambda x: F.length(F.regexp_replace(x, r"[^{]", "")) - F.length(F.regexp_replace(x, r"[^}]", ""))
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        last = F.size(a.out)
        joined = F.concat(F.slice(a.out, F.lit(1), F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(a.out, -1), F.lit(" and "), x)))
        out = F.when((a.depth > 0) & (last > 0), joined).otherwise(F.array_append(a.out, x))
        return F.struct(F.greatest(a.depth + depth(x), F.lit(0)).alias("depth"), out.alias("out"))

    return F.filter(F.transform(F.aggregate(parts, zero, add, lambda a: a.out), trim_ws), lambda x: x != "")


def parse_author(a: Column) -> Column:
    """``struct(literal, family, given)`` of one name."""
    literal = F.startswith(a, F.lit("{")) & F.endswith(a, F.lit("}"))
    comma = F.instr(a, ",")
    words = F.split(a, " ", -1)
    no = F.lit(None).cast("string")
    family = F.when(literal, no).when(comma > 0, trim_ws(F.substring_index(a, ",", 1))).otherwise(F.element_at(words, -1))
    given = F.when(literal, no).when(comma > 0, trim_ws(F.substr(a, comma + 1))).when(F.size(words) >= 2, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return F.struct(F.when(literal, F.regexp_replace(a, r"^\{|\}$", "")).alias("literal"), family.alias("family"), given.alias("given"))


def serialize_author(literal: Column, family: Column, given: Column) -> Column:
    e = lambda x: escape_bibtex(F.nullif(x, F.lit("")))
    return F.coalesce(F.concat(F.lit("{"), e(literal), F.lit("}")), F.concat_ws(", ", e(family), e(given)))


def fallback_part(key: Column, found: Column, author: Column, year: Column, locator: Column) -> Column:
    """One part of an author-date citation without a style; a missing entry shows its key."""
    first = F.get(split_authors(author), F.lit(0))
    a = parse_author(first)
    name = F.when(F.coalesce(author, F.lit("")) == "", key).otherwise(F.coalesce(a.literal, a.family, trim_ws(author)))
    extra = F.concat(F.coalesce(F.concat(F.lit(" "), F.nullif(year, F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(", "), F.nullif(locator, F.lit(""))), F.lit("")))
    return F.when(found, F.concat(name, extra)).otherwise(key)


def comment_attribution(author: Column, date: Column, text: Column) -> Column:
    a, d = F.nullif(author, F.lit("")), F.nullif(date, F.lit(""))
    return F.coalesce(F.concat(a, F.lit(" ("), d, F.lit("): "), text), F.concat(a, F.lit(": "), text), text)


def utc_iso(c: Column, fallback_zone: Column | None = None) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` in UTC; an offset in the text wins over the document's zone; other text as it is."""
    t = F.regexp_replace(c, " ", "T")
    own = c.rlike(r"T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})")
    zoned = F.concat(t, F.coalesce(fallback_zone, F.lit("Z")) if fallback_zone is not None else F.lit("Z"))
    text = F.when(own, c).when(t.rlike(r"T\d{2}:\d{2}"), zoned).otherwise(t)
    ts = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")])
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


#: Default sizes in half points.
BODY_HP = 22
HEADING_HP = {1: 32, 2: 26, 3: 24, 4: 22, 5: 20, 6: 18}


def font_sizes(size: Column, code_size: Column) -> Column:
    """``struct(body_hp, code_hp, headings)`` in half points; halves round up."""
    half = lambda x: F.floor(x + 0.5).cast("int")
    body = half(size * 2)
    code = F.when(code_size.isNotNull(), half(code_size * 2)).when(size.isNotNull(), F.greatest(F.lit(1), body - 2))
    return F.struct(body.alias("body_hp"), code.alias("code_hp"), F.array(*[half(F.lit(h) / BODY_HP * body) for h in HEADING_HP.values()]).alias("headings"))


def field_link(line: Column) -> Column:
    """``struct(field, value, url, valid)`` of a DOI, ISBN or ISSN line of a bibliography; null for others."""
    pattern = rf"(?i)^\s*(doi|isbn|issn)\s*=\s*[{{\"]\s*([^}}\"]+?)\s*[}}\"]"
    field = F.lower(F.regexp_extract(line, pattern, 1))
    value = trim_ws(F.regexp_replace(trim_ws(F.regexp_extract(line, pattern, 2)), r"^\{+|\}+$", ""))
    ok = F.when(field == "doi", value.rlike(r"^10\.\d{4,}[/.][A-Za-z0-9./_\-:;()]+$")).when(field == "isbn", value.rlike(r"^[\d-]{9,17}[\dXx]$")).otherwise(value.rlike(r"^\d{4}-?\d{3}[\dXx]$"))
    url = F.when(field == "doi", F.concat(F.lit("https://doi.org/"), F.replace(F.replace(value, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")))).when(field == "isbn", F.concat(F.lit("https://search.worldcat.org/isbn/"), value)).otherwise(F.concat(F.lit("https://portal.issn.org/resource/ISSN/"), value))
    return F.when((field != "") & (value != ""), F.struct(field.alias("field"), value.alias("value"), F.when(ok, url).alias("url"), ok.alias("valid")))


def hex8(c: Column) -> Column:
    return F.lpad(F.hex(c), 8, "0")


def chunks(c: Column, size: int = 240) -> Column:
    """Slices of at most ``size`` characters."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def set_front_line(c: Column, key: str, value: Column) -> Column:
    """Replace a key's line in front matter, insert it there, or put front matter before the text."""
    line = F.concat(F.lit(f"{key}: "), value)
    has = c.rlike(r"\A---\r?\n(?s:.*?)\r?\n---")
    head = F.regexp_extract(c, r"\A(---\r?\n(?s:.*?)\r?\n)---", 1)
    rest = F.substr(c, F.length(head) + 1)
    there = head.rlike(rf"(?m)^{key}:")
    # A literal replacement: the value may have signs that a pattern's replacement would read.
    before, after = F.regexp_extract(head, rf"(?s)\A(.*?\n){key}:[^\n]*", 1), F.regexp_extract(head, rf"(?s)\A.*?\n{key}:[^\n]*(.*)\z", 1)
    return F.when(has & there, F.concat(before, line, after, rest)).when(has, F.concat(head, line, F.lit("\n"), rest)).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n\n"), c))


#: Highlight colours of word processors, name, hex and the name in the file format.
PALETTE = [
    ("yellow", "FFFF00", "yellow"), ("green", "00FF00", "green"), ("turquoise", "00FFFF", "cyan"), ("pink", "FF00FF", "magenta"),
    ("blue", "0000FF", "blue"), ("red", "FF0000", "red"), ("dark-blue", "000080", "darkBlue"), ("teal", "008080", "darkCyan"),
    ("violet", "800080", "darkMagenta"), ("dark-red", "800000", "darkRed"), ("dark-yellow", "808000", "darkYellow"), ("gray-50", "808080", "darkGray"),
    ("gray-25", "C0C0C0", "lightGray"), ("black", "000000", "black"),
]


def color_name(c: Column) -> Column:
    """The palette's name of a name, hex value or format name; null if it has none."""
    by = {}
    for name, hexa, fmt in PALETTE:
        by |= {name: name, hexa.lower(): name, fmt.lower(): name}
    pairs = [F.lit(x) for kv in by.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_replace(c, "^#", "")))
