"""Text as columns: cleaning, paragraphs, sentences, headings, numerals, formats. All of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that stand for a space, and characters that go.
SPACES, REMOVED = "\u00a0\u2009\u202f", "\ufeff\u200b\u00ad"
#: Heading styles in the order of trust: (pattern of a line, number group, title group, needs a sequence).
HEADINGS = (
    (r"^[ \t]*(CHAPTER|Chapter)[ \t]+([IVXLCDM]+|\d+|[A-Za-z]+)\.?[ \t]*[:.\-]?[ \t]*(.*)$", 2, 3, False),
    (r"^[ \t]*(ADVENTURE|Adventure|LETTER|Letter|STAVE|Stave|CANTO|Canto|BOOK|Book|PART|Part|STORY|Story)[ \t]+([IVXLCDM]+|\d+|[A-Za-z]+)\.?[ \t]*[:.\-]?[ \t]*(.*)$", 2, 3, False),
    (r"^[ \t]*([IVXLCDM]{1,7}|\d{1,3})\.[ \t]*(.*)$", 1, 2, True),
    (r"^[ \t]*([IVXLCDM]{1,7}|\d{1,3})[ \t]*()$", 1, 2, True),
)
#: Numerals, headings that stand alone, list marks, sentence ends, licence marks, page numbers.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
STANDALONE = r"(?i)^\s*(?:(?:chapter|part|book|canto|stave|act|section)\s+[ivxlcdm\d]+[.\s]*|epilogue|prologue|contents|preface|introduction|foreword|dedication|appendix|afterword|colophon)\s*$"
LIST_MARKER = r"(?i)^\s*([-*•‣▪–—]|\(?\d{1,3}[.)]|\(?[ivxlcdm]{1,6}[.)])\s+"
SENTENCE_END = r"""[.!?…:]["'”’)\]]*$"""
CONTINUES = r"""^[a-z,;:!?.)\]…"'”’]"""
START_MARK = r"(?is)^.*?\*\*\*\s*START OF (?:THE|THIS)?\s*PROJECT GUTENBERG EBOOK.*?\*\*\*"
END_MARK = r"(?is)\*\*\*\s*END OF (?:THE|THIS)?\s*PROJECT GUTENBERG EBOOK.*$"
CREDITS = r"(?im)^[ \t]*(produced by|prepared by|transcribed by|e-?text prepared by|updated editions will)\b.*$"
LICENCE = r"(?im)^[ \t]*(START|END): FULL LICENSE.*?$|^[ \t]*THE FULL PROJECT GUTENBERG LICENSE.*?$"
PAGE_NUMBER = r"(?i)^\s*[\[\(\-–—]*\s*(\d{1,4}|[ivxlcdm]{1,7})\s*[\]\)\-–—]*\s*$"


def strip(t: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def tokens(t: Column) -> Column:
    return F.array_remove(F.split(t, r"(?U)\s+"), "")


def word_count(t: Column) -> Column:
    return F.size(tokens(t))


def collapse(t: Column) -> Column:
    """One space between words, none at the ends."""
    return F.array_join(tokens(t), " ")


def clean(t: Column) -> Column:
    """Line ends, odd characters, tabs, trailing spaces and runs of blank lines."""
    plain = F.translate(F.regexp_replace(t, "\r\n?", "\n"), SPACES + "\t" + REMOVED, " " * (len(SPACES) + 1))
    return F.regexp_replace(F.regexp_replace(plain, r"(?m)[ ]+$", ""), "\n{3,}", "\n\n")


def tidy_spacing(t: Column) -> Column:
    """No space before closing punctuation or after an opener."""
    return F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:!?%)\]}»”’])", "$1"), r"([(\[{«“])\s+", "$1")


def strip_boilerplate(t: Column) -> Column:
    """What stands between the licence markers, without credit lines; a text without markers stays."""
    inner = F.regexp_replace(F.regexp_replace(t, START_MARK, ""), END_MARK, "")
    return strip(F.regexp_replace(F.regexp_replace(inner, CREDITS, ""), LICENCE, ""))


def paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda x: x != "")


def lines(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")


def sentences(t: Column) -> Column:
    return F.split(t, r"(?<=[.!?])\s+")


def summary(t: Column, limit: int = 240) -> Column:
    """Leading sentences while they fit the limit, else the first characters. The fold carries one short string."""
    body = F.regexp_replace(strip(t), r"\s+", " ")
    zero = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        longer = F.when(s["out"] == "", x).otherwise(F.concat(s["out"], F.lit(" "), x))
        fits = ~s["full"] & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(s["out"]).alias("out"), (~fits).alias("full"))

    found = F.aggregate(sentences(body), zero, step)["out"]
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(body, 1, limit))


def roman(t: Column) -> Column:
    """Value of a roman numeral read from the right: a digit below the largest seen counts off. Null for other text."""
    values = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.reverse(F.array_remove(F.split(F.upper(t), ""), ""))
    step = lambda s, c: F.struct((s["n"] + F.when(values[c] < s["most"], -values[c]).otherwise(values[c])).alias("n"), F.greatest(s["most"], values[c]).alias("most"))
    return F.when(F.upper(t).rlike("^[IVXLCDM]+$"), F.aggregate(digits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("most")), step)["n"])


def heading_number(t: Column) -> Column:
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).otherwise(roman(t))


def is_listing(t: Column, least_lines: int = 8, below: float = 5.0) -> Column:
    """Many short lines, as in a table of contents."""
    ls = lines(t)
    total = F.aggregate(F.transform(ls, word_count), F.lit(0), lambda a, b: a + b)
    return (F.size(ls) >= least_lines) & (total < F.size(ls) * F.lit(below))


def is_verse_or_list(ls: Column) -> Column:
    """Whether an array of lines breaks on purpose: marked items, or short lines throughout."""
    kept = F.filter(F.transform(ls, strip), lambda x: x != "")
    n, marked = F.size(kept), F.size(F.filter(kept, lambda x: x.rlike(LIST_MARKER)))
    sizes = F.transform(kept, F.length)
    short = (F.array_max(sizes) <= 50) & (F.aggregate(sizes, F.lit(0), lambda a, b: a + b) <= 45 * n)
    return (n >= 4) & ((marked >= F.greatest(F.lit(2), n * 0.6)) | short)


def join_wrapped(ls: Column) -> Column:
    """Lines as one paragraph; a hyphen between lower-case letters at a line's end is a wrap and goes."""
    joined = F.array_join(F.filter(F.transform(ls, strip), lambda x: x != ""), "\n")
    return F.replace(F.regexp_replace(joined, r"([a-z])-\n(?=[a-z])", "$1"), F.lit("\n"), F.lit(" "))


def merge_continuations(ps: Column) -> Column:
    """Paragraphs broken in mid-sentence, rejoined; verse, lists and headings stay apart.

    A paragraph goes on the one before if that one ends open and this one starts in lower case. Whether it does
    depends only on the last piece, so pieces are grouped by a running count and joined once.
    """
    kept = F.filter(F.transform(ps, strip), lambda x: x != "")

    def goes_on(x: Column, i: Column, a: Column) -> Column:
        before = F.get(a, i - 1)
        return F.coalesce((i > 0) & ~F.contains(before, F.lit("\n")) & ~F.contains(x, F.lit("\n")) & ~before.rlike(STANDALONE) & ~before.rlike(SENTENCE_END) & x.rlike(CONTINUES), F.lit(False))

    marked = _let(kept, lambda a: F.transform(a, lambda x, i: F.concat(F.when(goes_on(x, i, a), F.lit(" ")).otherwise(F.lit("\u0001")), x)))
    return F.array_remove(F.split(F.array_join(marked, ""), "\u0001"), "")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def split_groups(ls: Column) -> Column:
    """array<array<string>>: lines grouped into paragraphs by indentation, each standalone heading alone.

    Where some lines stand flush and others are indented by two or more, the kind of the first line starts paragraphs.
    """
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
    mixed = F.exists(ls, lambda x: indent(x) == 0) & F.exists(ls, lambda x: indent(x) >= 2)
    starts = lambda x: F.when(indent(ls[0]) == 0, indent(x) == 0).otherwise(indent(x) >= 2)
    alone = lambda x: x.rlike(STANDALONE)
    marked = F.transform(ls, lambda x, i: F.concat(F.when((i > 0) & ((mixed & starts(x)) | alone(x) | F.coalesce(alone(F.get(ls, i - 1)), F.lit(False))), F.lit("\u0001")).otherwise(""), x))
    return F.transform(F.split(F.regexp_replace(F.array_join(marked, "\n"), "\n\u0001", "\u0001"), "\u0001"), lambda g: F.split(g, "\n"))


def normalize_paragraphs(t: Column) -> Column:
    """Blank-line-separated blocks as one paragraph each: wraps joined, verse and lists kept, broken sentences rejoined."""
    trimmed = lambda ls: F.array_join(F.transform(ls, strip), "\n")
    each = lambda g: F.when(is_verse_or_list(g), trimmed(g)).otherwise(join_wrapped(g))
    block = lambda ls: F.when(is_verse_or_list(ls), F.array(trimmed(ls))).otherwise(F.transform(split_groups(ls), each))
    blocks = F.transform(F.split(clean(t), r"\n[ \t]*\n"), lambda b: F.filter(F.split(b, "\n"), lambda x: strip(x) != ""))
    ps = F.flatten(F.transform(F.filter(blocks, lambda ls: F.size(ls) > 0), lambda ls: _let(ls, block)))
    joined = F.array_join(_let(ps, merge_continuations), "\n\n")
    return strip(tidy_spacing(F.regexp_replace(joined, " {2,}", " ")))


def normalize_uploaded(t: Column, source: str = "txt") -> Column:
    """The upload pipeline's text: boilerplate off and paragraphs rejoined, or for ``epub`` only spacing tidied."""
    if source == "epub":
        return strip(tidy_spacing(F.regexp_replace(clean(t), " {2,}", " ")))
    return normalize_paragraphs(strip_boilerplate(t))


def repair_split_capitals(t: Column) -> Column:
    """A first letter that extraction set apart, rejoined: up to three times, A and I only before an unpronounceable rest."""
    out = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)^\s+", "")
    for _ in range(3):
        out = F.regexp_replace(out, r"^([B-HJ-Z])\s+([A-Z]{2,}(?![A-Za-z])|[a-z]{2,}(?![A-Za-z]))", "$1$2")
        out = F.regexp_replace(out, r"^([AI])\s+([B-DF-HJ-NP-TV-XZ]{2}[A-Z]*(?![A-Za-z])|[b-df-hj-np-tv-xz]{2}[a-z]*(?![A-Za-z]))", "$1$2")
    return out


#: Words that stand in prose and not in names, and signs that no name has.
PROSE_WORDS = (
    "a", "an", "the", "of", "to", "in", "on", "at", "by", "for", "from", "with", "that", "this", "these", "those", "it", "its", "their", "our", "we", "they",
    "is", "are", "was", "were", "be", "been", "has", "have", "had", "can", "will", "would", "should", "may", "which", "when", "while", "where",
    "according", "ensure", "using", "used", "based", "labeled", "labelled", "paper", "study", "dataset", "data", "method", "results", "propose",
    "present", "show", "shows", "described", "credibility", "tactics",
)
NAME_TOKEN = r"^(?:[A-Z]\.|[A-Z][A-Za-z'’\-]*\.?|van|von|de|del|der|di|da|la|le|bin|al)$"
NO_NAME = r"(?i)\d|@|https?://|[/:()\[\]{}<>+=*]|\b(universit\w*|institut\w*|department|dept|laborator\w*|college|school|faculty|centre|center|corp|inc|ltd|gmbh|abstract|keywords?|index terms)\b"


def is_byline(t: Column) -> Column:
    """Whether a line is a list of authors' names and not a sentence."""
    bare = collapse(F.coalesce(t, F.lit("")))
    names = F.filter(F.transform(F.split(bare, r"(?i),|;|\sand\s|\s&\s|·|\|"), strip), lambda x: x != "")
    word = lambda x: x.rlike(r"^[A-Z]\.?$") | (~F.lower(F.regexp_replace(x, r"^\.+|\.+$", "")).isin(*PROSE_WORDS) & x.rlike(NAME_TOKEN))
    fits = F.forall(names, lambda n: F.size(tokens(n)).between(1, 4) & F.forall(tokens(n), word))
    plain = (bare != "") & (F.length(bare) <= 120) & ~bare.rlike(NO_NAME) & ~bare.rlike(r"[A-Za-z]{2,}\.(\s|$)") & ~bare.rlike("[,;:]$")
    return plain & F.size(names).between(1, 12) & fits & ((F.size(names) > 1) | (F.size(tokens(names[0])) > 1))


def paragraph_starts(t: Column) -> Column:
    """array<struct<text, start>>: paragraphs between runs of two or more line feeds, with code point offsets."""
    gaps = F.regexp_extract_all(t, F.lit("\n{2,}"), 0)
    parts = F.split(t, "\n{2,}")
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.expr("cast(array() as array<struct<text:string,start:int>>)").alias("out")),
        lambda s, x: F.struct((s["at"] + F.length(x) + F.coalesce(F.length(F.get(gaps, s["i"])), F.lit(0))).alias("at"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.struct(x.alias("text"), s["at"].alias("start")))).alias("out")),
    )
    return walked["out"]


def segments(full: Column, start: Column, text: Column, spans: Column) -> Column:
    """array<struct<text, id>> of a paragraph at ``start``: cut by ``spans`` (array of id, start, end, quote).

    Spans whose quote is not what stands there are skipped, and so is one that begins inside another already drawn.
    """
    end = start + F.length(text)
    fresh = F.filter(spans, lambda h: (h["start"] >= 0) & (F.substr(full, h["start"] + 1, h["end"] - h["start"]) == h["quote"]))
    cuts = F.array_sort(F.filter(F.transform(fresh, lambda h: F.struct(F.greatest(h["start"], start).alias("from"), F.least(h["end"], end).alias("upto"), h["id"].alias("id"))), lambda c: c["from"] < c["upto"]))
    kind = "array<struct<text:string,id:bigint>>"
    piece = lambda a, b, i: F.array(F.struct(F.substr(text, a - start + 1, b - a).alias("text"), i.cast("bigint").alias("id")))
    none = F.expr(f"cast(array() as {kind})")
    plain = lambda a, b: F.when(a < b, piece(a, b, F.lit(None))).otherwise(none).cast(kind)
    step = lambda s, c: F.when(c["from"] < s["at"], s).otherwise(F.struct(c["upto"].alias("at"), F.concat(s["out"], plain(s["at"], c["from"]), piece(c["from"], c["upto"], c["id"]).cast(kind)).alias("out")))
    done = F.aggregate(cuts, F.struct(start.alias("at"), none.alias("out")), step)
    return _let(done, lambda d: F.concat(d["out"], plain(d["at"], end)))


_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def utf16_offset(t: Column, at: Column) -> Column:
    """UTF-16 units before the ``at``-th code point (from 0; past the end: of the whole text)."""
    head = F.left(t, F.greatest(at, F.lit(0)))
    return F.length(head) + F.regexp_count(head, F.lit(_ASTRAL))


def code_point_offset(t: Column, at: Column) -> Column:
    """Code points that begin before the ``at``-th UTF-16 unit; a cut through a pair counts its first half."""
    head = F.left(t, F.greatest(at, F.lit(0)))
    step = lambda s, c: F.when(s["units"] >= at, s).otherwise(F.struct((s["units"] + F.when(c.rlike(_ASTRAL), 2).otherwise(1)).alias("units"), (s["n"] + 1).alias("n")))
    walked = F.aggregate(F.array_remove(F.split(head, ""), ""), F.struct(F.lit(0).alias("units"), F.lit(0).alias("n")), step)["n"]
    return F.when(head.rlike(_ASTRAL), walked).otherwise(F.length(head))


#: Titles that say nothing, endings of file names, and programs that sign as author.
PLACEHOLDER_TITLES = ("untitled", "unknown", "microsoft word", "document", "pdf")
FILE_NAME = r"\.(pdf|docx?|tex|indd)$"
SOFTWARE_NAMES = (
    "microsoft word", "microsoft powerpoint", "microsoft office word", "word", "adobe acrobat", "acrobat", "adobe indesign", "adobe illustrator", "libreoffice", "openoffice",
    "libreoffice writer", "openoffice writer", "pages", "preview", "quartz pdfcontext", "ghostscript", "pdftex", "latex", "pdflatex", "xetex", "xelatex", "tex", "google docs", "unknown", "user", "administrator", "untitled",
)


def is_plausible_title(t: Column) -> Column:
    """Whether an embedded title is one: 8 to 400 characters, no placeholder and no file name. Null is not."""
    bare = strip(F.coalesce(t, F.lit("")))
    low = F.lower(bare)
    named = F.exists(F.array(*[F.lit(x) for x in PLACEHOLDER_TITLES]), lambda x: F.contains(low, x))
    return F.length(bare).between(8, 400) & ~named & ~low.rlike(FILE_NAME)


def is_software_name(t: Column) -> Column:
    """Whether an author field holds a program's name, whole and in any case."""
    return F.lower(collapse(F.coalesce(t, F.lit("")))).isin(*SOFTWARE_NAMES)


def safe_filename(name: Column) -> Column:
    base = F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(base, "[^A-Za-z0-9 ._-]", "")), 1, 120), F.lit("")), F.lit("upload"))


def sniff(name: Column, content: Column) -> Column:
    """Struct of format and error: the extension must be known and agree with the first bytes (zip content is told apart by its reader)."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.]*)$", 1))
    head = F.hex(F.substring(content, 1, 5))
    actual = F.when(head == "255044462D", "pdf").when(head.startswith("504B0304"), "epub").otherwise("txt")
    error = F.when(~ext.isin("txt", "epub", "pdf"), "unsupported_extension").when(actual != ext, "extension_mismatch")
    return F.struct(F.when(error.isNull(), actual).alias("format"), error.alias("error"))


def decode_text(content: Column) -> Column:
    """UTF-8 if it is, else Latin-1; null if under 85 percent of the first 20,000 characters are printable."""
    raw = F.decode(content, "UTF-8")
    text = F.when(F.is_valid_utf8(content.cast("string")), raw).otherwise(F.decode(content, "ISO-8859-1"))
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    sample = F.substring(text, 1, 20_000)
    shown = F.length(F.regexp_replace(sample, r"(?U)[^\p{Print}\n\r\t]", ""))
    return F.when((F.length(sample) > 0) & (shown >= 0.85 * F.length(sample)), text)


def csv_cell(value: Column) -> Column:
    """A quoted CSV cell; a text that a spreadsheet would run starts with an apostrophe."""
    t = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(t.rlike(r"^[\t\r]|^\s*[=+\-@]"), F.concat(F.lit("'"), t)).otherwise(t)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def markdown_escape(t: Column) -> Column:
    return F.regexp_replace(t, r"([\\`*_{}\[\]<>#+\-!|])", r"\\$1")


def html_escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def html_blocks(html: Column) -> Column:
    """array<string> of the texts of p, blockquote and li elements, scripts and styles dropped, tags as spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    inner = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:p|blockquote|li)\b[^>]*>(.*?)</(?:p|blockquote|li)\s*>"), 1)

    def plain(x: Column) -> Column:
        t = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return strip(tidy_spacing(F.regexp_replace(t, r"(?U)\s+", " ")))

    return F.filter(F.transform(inner, plain), lambda x: x != "")
