"""Text functions as Column expressions, free of Python code on the executors.

White space is ECMAScript's, spelled out as a class, since Java's and Python's differ from it.
Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ECMAScript white space as a Java regular expression (as a list of its characters it takes five times as long), and those characters.
JSWS = "[\\s\\p{Z}\\uFEFF]"
JSWS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Publishing categories, and spellings that stand for one of them.
CATEGORIES = ("Romance", "Thriller", "Sci-Fi", "Historical", "Fantasy", "Contemporary", "Urban Fantasy")
CATEGORY_ALIASES = {"science fiction": "Sci-Fi", "sci fi": "Sci-Fi", "scifi": "Sci-Fi", "urban-fantasy": "Urban Fantasy"}


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JSWS_CHARACTERS))


def collapse(c: Column) -> Column:
    """Trimmed, with each run of white space one space."""
    return F.regexp_replace(js_trim(c), f"{JSWS}+", " ")


def words(c: Column) -> Column:
    """Non-empty words."""
    return F.filter(F.split(c, f"{JSWS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.regexp_count(c, F.lit(JSWS.replace("[", "[^", 1) + "+")).cast("long")


def split_count(c: Column) -> Column:
    """Parts of the trimmed text between white space; one in an empty text."""
    return F.greatest(word_count(c), F.lit(1).cast("long"))


#: Word characters, apostrophes and hyphens that begin and end beside a word character.
TOKEN = "[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_’'-]*[\\p{L}\\p{N}_])?"


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN)).cast("long")


#: Nine tokens or more, each whole: none is tried again shorter. The rest of the line is not read.
LONG_LINE = "^(?:[^\\p{L}\\p{N}_]*+(?>" + TOKEN + ")){9}"


def translation_units(c: Column) -> Column:
    """Tokens and single other signs; at least one."""
    return F.greatest(F.regexp_count(c, F.lit(TOKEN + "|" + JSWS.replace("[", "[^", 1))).cast("long"), F.lit(1).cast("long"))


def stored_word_count(stored: Column, c: Column) -> Column:
    """The stored count if it is there and not negative, else the words of the text."""
    return F.when(stored >= 0, stored.cast("long")).otherwise(word_count(c))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(js_trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


#: Latin letters with marks and their plain letters, for slugs.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def slugify_latin(c: Column) -> Column:
    """As slugify, after taking the marks off Latin letters."""
    return slugify(F.translate(F.regexp_replace(F.lower(c), "[\\u0300-\\u036f]", ""), _MARKED, _PLAIN))


def paragraphs(c: Column, mark: str = "\\n\\s*\\n") -> Column:
    return F.filter(F.transform(F.split(c, mark), js_trim), lambda p: p != "")


def first_sentence(c: Column) -> Column:
    """Up to the first white space that follows a sentence mark."""
    return F.element_at(F.split(c, "(?<=[.!?。！？])\\s+"), 1)


def html_escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def script_safe(c: Column) -> Column:
    """JSON text that may stand within a script element."""
    for sign, name in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def payload(c: Column) -> Column:
    """The text without white space: what must survive any reflowing."""
    return F.regexp_replace(c, JSWS, "")


def fingerprint(c: Column, edge: str) -> Column:
    """SHA-256 of the first or last 512 characters of the payload."""
    return edge_digest(payload(c), edge)


def edge_digest(p: Column, edge: str) -> Column:
    """As fingerprint, of a payload."""
    return F.sha2(F.substring(p, 1, 512) if edge == "start" else F.right(p, F.lit(512)), 256)


def normalize_tags(tags: Column) -> Column:
    """Collapsed, non-empty, distinct without regard to case, the first spelling kept."""

    def distinct(clean: Column) -> Column:
        return bound(F.transform(clean, F.lower), lambda lower: F.filter(clean, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1))

    return bound(F.filter(F.transform(tags, collapse), lambda t: t != ""), distinct)


def tag_list(c: Column) -> Column:
    """Tags out of a text: a JSON array, of which only strings count, or else values between commas; none for null."""
    listed = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    strings = F.transform(F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(F.substring(js_trim(c), 1, 1) == "[", F.coalesce(strings, F.split(c, ","))).otherwise(F.split(c, ","))


def tag_key(tags: Column) -> Column:
    """Equal for equal multisets of tags without regard to case."""
    return F.array_sort(F.transform(tags, F.lower))


def normalize_category(c: Column) -> Column:
    """The canonical category, or ''."""
    table = {name.lower(): name for name in CATEGORIES} | CATEGORY_ALIASES
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    key = F.replace(F.lower(collapse(c)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.replace(key, F.lit("-"), F.lit(" "))), F.lit(""))


def chapter_label(number: Column) -> Column:
    return F.format_string("%02d", number)


def display_title(title: Column) -> Column:
    """A chapter title without its "Chapter N:" beginning."""
    return F.regexp_replace(title, "(?i)^\\s*(?:chapter|sura(?: ya)?)\\s+\\d+\\s*[:：–—-]\\s*", "")


def uri_component(c: Column) -> Column:
    """Percent-encoded, as a path part."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def summary(c: Column, limit: int = 320) -> Column:
    """The first paragraph, collapsed and cut."""
    return F.substring(collapse(F.element_at(F.split(c, "\\n\\s*\\n"), 1)), 1, limit)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often ``make`` uses it, in nested functions too."""
    return F.element_at(F.transform(F.array(value), make), 1)


def ngrams(tokens: Column, longest: int = 12) -> Column:
    """All runs of 1 to ``longest`` tokens, joined by spaces."""

    def runs(t: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(t)))
        each = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda k: F.array_join(F.slice(t, k, n), " ")))
        return F.when(F.size(t) > 0, F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def normalized_heading(c: Column) -> Column:
    """Letters and digits of a heading, lower-cased, with single spaces."""
    plain = F.translate(F.lower(F.regexp_replace(js_trim(c), "^#{1,6}\\s+|^[_*]+|[_*]+$", "")), _MARKED, _PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


#: Fixed patterns of the block kinds, in the order in which they apply.
BLOCK_PATTERNS = (
    ("scene_break", "^(?:\\*\\s*){3,}$|^(?:-\\s*){3,}$|^(?:_\\s*){3,}$|^#$"),
    ("heading", "(?i)^(?:#{1,6}\\s+\\S.*|(?:chapter|book|part|volume|act|scene|prologue|epilogue)\\b[^.!?]{0,80})$"),
    ("letter", "(?i)^(?:dear|my dear)\\b.{0,60}[,:—]"),
    ("list", "^(?:[-*•]\\s+|\\d{1,3}[.)]\\s+)\\S"),
)


def block_kind(c: Column) -> Column:
    """scene_break, heading, letter, list, poetry (most of its lines short) or prose."""
    return bound(js_trim(c), _trimmed_kind)


def _trimmed_kind(t: Column) -> Column:
    """``block_kind`` of a trimmed text. Only one of two lines or more is cut into lines."""

    def poetry(lines: Column) -> Column:
        return F.size(F.filter(lines, lambda line: ~line.rlike(LONG_LINE))) >= 0.8 * F.size(lines)

    kind = F.when(F.contains(t, F.lit("\n")) & bound(paragraphs(t, "\n"), poetry), "poetry").otherwise("prose")
    for name, pattern in reversed(BLOCK_PATTERNS):
        kind = F.when(t.rlike(pattern), name).otherwise(kind)
    return kind


def blocks(c: Column, mark: str = "\\n\\s*\\n") -> Column:
    """The blocks of a text, in order: structs of kind and text."""
    return F.transform(paragraphs(c, mark), lambda p: F.struct(_trimmed_kind(p).alias("kind"), p.alias("text")))


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^#{1,6}[ \\t]+", "")


def html_text(c: Column) -> Column:
    """Text of an HTML page without scripts, styles, comments and tags."""
    c = F.regexp_replace(c, "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return collapse(c)


def title_case(c: Column) -> Column:
    """Lower-cased, the first letter of each word upper."""
    parts = F.split(F.lower(c), "(?<![\\p{L}\\p{N}_])(?=\\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def dotted_times(c: Column) -> Column:
    """Colons between digits as dots, so that no heading is cut at one."""
    return F.regexp_replace(c, "(\\d):(?=\\d)", "$1.")


def detail_synopsis(c: Column) -> Column:
    """The lines of the section headed "Version B" or "Toleo B", quote marks and rules taken off."""
    body = F.regexp_extract(c, "(?ims)^##\\s+(?:Version B|Toleo B)\\b[^\\n]*$(.*?)(?=^##\\s|\\z)", 1)
    lines = F.transform(F.split(body, "\\n"), lambda x: F.regexp_replace(js_trim(x), "^>\\s?", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "---")), "\n\n")


def thousands(count: Column, unit: str = "words") -> Column:
    return F.concat(F.floor(count / 1000 + 0.5).cast("string"), F.lit(f"k {unit}"))


def cover_address(c: Column, width: int, store: str, stored: str, rendered: str) -> Column:
    """An image address of ``store`` turned into that of a rendering ``width`` wide; others stay.

    ``stored`` and ``rendered`` are the path parts of originals and renderings; a version ``v`` is kept.
    """
    version = F.regexp_extract(c, "[?&]v=([^&#]*)", 1)
    base = F.replace(F.regexp_extract(c, "^([^?#]*)", 1), F.lit(stored), F.lit(rendered))
    made = F.concat(base, F.lit("?"), F.when(version != "", F.concat(F.lit("v="), version, F.lit("&"))).otherwise(""), F.lit(f"width={width}&resize=contain&quality=76"))
    host = F.regexp_extract(c, "^https?://([^/?#]+)", 1)
    return F.when(host.endswith(store) & F.contains(c, F.lit(stored)), made).otherwise(c)


def absolute_address(c: Column, site: str, default: str) -> Column:
    """A path or an HTTP address as an address; anything else is that of ``default``."""
    return F.when(c.rlike("^/(?!/)"), F.concat(F.lit(site), c)).when(c.rlike("^https?://[^/?#]"), c).otherwise(F.lit(site + default))


def own_path(c: Column, site: str) -> Column:
    """The path of an address of the site itself, null for any other."""
    rest = F.substring(c, len(site) + 1, 1 << 30)
    return F.when(c.startswith(site) & rest.rlike("^(?:$|[/?#])"), F.regexp_extract(rest, "^([^?#]*)", 1))


def prompt(instruction: str, context: Column, request: Column) -> Column:
    """A prompt of an instruction, at most 1500 characters of context, and at most 300 of a request."""
    return F.concat(F.lit(instruction + "\n\n"), F.substring(context, 1, 1500), F.lit("\n\n"), F.substring(request, 1, 300))
