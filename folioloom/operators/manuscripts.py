"""Chapters of manuscripts as column expressions over their lines: marked chapters, plain texts, numbered lines, and
what a manuscript tells of itself.

A document is an array of lines; headings are found line by line, and chapters are the slices between them, so
nothing is shuffled and no Python runs. Null texts are empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text

from .segment import fixed

#: Numbers as words.
ENGLISH = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20), strict=True))
ENGLISH_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
KISWAHILI = dict(zip("moja mbili tatu nne tano sita saba nane tisa".split(), range(1, 10), strict=True))
KISWAHILI_TENS = dict(zip("kumi ishirini thelathini arobaini hamsini sitini sabini themanini tisini".split(), range(10, 100, 10), strict=True))
KISWAHILI_FIRST = {"kwanza": 1, "pili": 2}
#: What parts a number from a title, and chapters' names.
DELIMITER, SURA = "[:：–—-]", "sura(?:\\s+ya)?"

_ENGLISH_NUMBERS = ENGLISH | ENGLISH_TENS | {f"{t} {u}": a + b for t, a in ENGLISH_TENS.items() for u, b in ENGLISH.items() if b < 10} | {"one hundred": 100}
_KISWAHILI_NUMBERS = KISWAHILI | KISWAHILI_TENS | KISWAHILI_FIRST | {f"{t} na {u}": a + b for t, a in KISWAHILI_TENS.items() for u, b in (KISWAHILI | KISWAHILI_FIRST).items()} | {"mia moja": 100}


def _pattern(numbers: dict[str, int]) -> str:
    """Digits, or a number in words, the longest first; parts may be joined by dashes."""
    longest = sorted(numbers, key=lambda n: (-len(n.split()), -len(n), n))
    return "(?:\\d+|" + "|".join(n.replace(" ", "[\\s–—-]+") for n in longest) + ")"


_NUMBER = {"en": _pattern(_ENGLISH_NUMBERS), "sw": _pattern(_KISWAHILI_NUMBERS)}


def spoken_number(c: Column, numbers: dict[str, int]) -> Column:
    """The value of digits or of a number in words, null if it is none."""
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-–—]", " "), "\\s+", " "))
    return F.coalesce(F.when(plain.rlike("^\\d{1,9}$"), plain.cast("int")), F.try_element_at(known, plain))


def chapter_heading(line: Column) -> Column:
    """struct(number, title, language) of a line "Chapter N: Title" or "Sura ya N: Title", null for any other.

    A line without a heading mark needs a delimiter. Numbers are digits or words, hyphenated ones whole; zero is none.
    """

    def of(language: str, name: str, numbers: dict[str, int], trimmed: Column) -> Column:
        number = _NUMBER[language]
        head = f"(?i)^(#{{1,6}}\\s+)?{name}\\s+"
        rest = F.regexp_extract(trimmed, f"{head}(.+)$", 2)
        marked = F.regexp_extract(trimmed, f"{head}(.+)$", 1) != ""
        parted = f"(?i)^({number})\\s*{DELIMITER}\\s*(.*)$"
        spaced = "^(\\d+)\\s+(.+)$"
        cut = rest.rlike(DELIMITER)
        told = (
            F.when(rest.rlike(f"(?i)^{number}$"), F.struct(spoken_number(rest, numbers).alias("number"), F.lit("").alias("title")))
            .when(rest.rlike(parted), F.struct(spoken_number(F.regexp_extract(rest, parted, 1), numbers).alias("number"), text.js_trim(F.regexp_extract(rest, parted, 2)).alias("title")))
            .when(rest.rlike(spaced), F.struct(spoken_number(F.regexp_extract(rest, spaced, 1), numbers).alias("number"), text.js_trim(F.regexp_extract(rest, spaced, 2)).alias("title")))
        )
        good = (rest != "") & (marked | cut) & (told["number"] > 0)
        return F.when(good, F.struct(told["number"].alias("number"), told["title"].alias("title"), F.lit(language).alias("language")))

    trimmed = text.js_trim(line)
    return F.when(
        trimmed.rlike("(?i)^(?:#{1,6}\\s+)?(?:chapter|sura)\\s"),  # most lines end here
        F.coalesce(of("en", "chapter", _ENGLISH_NUMBERS, trimmed), of("sw", SURA, _KISWAHILI_NUMBERS, trimmed)),
    )


def unix_lines(c: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n"), "\n")


def without_front_block(c: Column) -> Column:
    """The text with line feeds alone, without a block between two rules at its very beginning."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r\\n?", "\n"), "\\A(?s:---.*?---\\s*)", "")


def cut_at(lines: Column, heading, keep: Callable[[Column], Column] | None = None) -> Column:
    """Arrays of (heading, lines): a chapter for each line for which ``heading`` is not null; what stands before is left out.

    ``keep`` makes of all heads (at, heading) those that count.
    """

    def found(rows: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda line, k: F.struct(k.alias("at"), heading(line).alias("heading"))), lambda h: h["heading"].isNotNull())
        return F.struct(rows.alias("rows"), (text.bound(heads, keep) if keep else heads).alias("heads"))

    def slices(both: Column) -> Column:
        def one(h, k):
            end = F.coalesce(F.get(both["heads"], k + 1)["at"], F.size(both["rows"]))
            return F.struct(h["heading"].alias("heading"), F.slice(both["rows"], h["at"] + 2, end - h["at"] - 1).alias("lines"))

        return F.transform(both["heads"], one)

    return text.bound(text.bound(lines, found), slices)


def joined(lines: Column) -> Column:
    return text.js_trim(F.array_join(lines, "\n"))


def marked_chapters(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, number, title, content) of the chapters of every document whose headings are marked, in order, those without content left out."""
    lines = F.split(text.js_trim(without_front_block(F.col("text"))), "\n")
    found = rows.select(key, F.explode(cut_at(lines, chapter_heading)).alias("_c")).select(key, "_c.heading.*", joined(F.col("_c.lines")).alias("content"))
    named = F.concat(F.when(F.col("language") == "sw", "Sura ya ").otherwise("Chapter "), F.col("number").cast("string"))
    return found.where("content <> ''").select(key, "number", F.coalesce(F.nullif("title", F.lit("")), named).alias("title"), "content")


def problems(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, problem): why a manuscript cannot be published: glued headings, no chapters, broken numbering."""
    glue = "(?i)^(.*?)#{1,6}\\s+(?:chapter|sura(?:\\s+ya)?)\\s+"
    numbered = F.transform(unix_lines(F.col("text")), lambda line, k: F.when(F.regexp_extract(line, glue, 1) != "", F.concat(F.lit("glued heading on line "), (k + 1).cast("string"))))
    glued = rows.select(key, F.explode(F.array_compact(numbered)).alias("problem"))
    lines = F.split(text.js_trim(without_front_block(F.col("text"))), "\n")
    kept = F.filter(cut_at(lines, chapter_heading), lambda c: joined(c["lines"]) != "")
    numbers = F.transform(kept, lambda c: c["heading"]["number"])
    counted = text.bound(numbers, lambda n: F.when(F.size(n) == 0, "no chapters").when(n != F.sequence(F.lit(1), F.size(n)), "numbers are not 1, 2, ..."))
    return glued.unionByName(rows.select(key, counted.alias("problem")).where("problem is not null"))


def greedy_groups(sizes: Column, limit: int) -> Column:
    """Places, from 1 on, at which groups begin: one is closed when it has ``limit`` or more."""
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.array().cast("array<boolean>").alias("begins"))

    def step(state, size):
        begins = (F.size(state["begins"]) == 0) | (state["held"] >= limit)
        return F.struct((F.when(begins, F.lit(0)).otherwise(state["held"]) + size).alias("held"), F.concat(state["begins"], F.array(begins)).alias("begins"))

    flags = F.aggregate(sizes, start, step)["begins"]
    return F.filter(F.transform(flags, lambda b, k: F.when(b, k + 1)), lambda k: k.isNotNull())


PLAIN = "(?i)^[ \\t]*(?:chapter|sura(?:[ \\t]+ya)?|section|第)[ \\t]*(\\d+|[一二三四五六七八九十百]+)[ \\t]*[:章.\\-]*[ \\t]*(.*)$"


def plain_chapters(rows: DataFrame, key: str = "doc_id", fallback_characters: int = 3000) -> DataFrame:
    """(key, number, title, content) of plain texts: chapters below lines like "Chapter 3: Title", numbered as they come, those
    without content left out; without any such line, paragraphs gathered to ``fallback_characters`` at least."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    heading = lambda line: F.when(line.rlike(PLAIN), F.coalesce(F.nullif(text.js_trim(F.regexp_extract(line, PLAIN, 2)), F.lit("")), F.concat(F.lit("Chapter "), F.regexp_extract(line, PLAIN, 1))))
    cut = rows.select(key, F.coalesce("text", F.lit("")).alias("_t"), cut_at(lines, heading).alias("_c"))
    chapter = lambda number, title, content: F.struct(number.alias("number"), title.alias("title"), content.alias("content"))
    own = F.filter(F.split("_t", "\\n\\s*\\n"), lambda p: text.js_trim(p) != "")

    def grouped(paragraphs: Column) -> Column:
        places = greedy_groups(F.transform(paragraphs, lambda p: (F.length(p) + 2).cast("bigint")), fallback_characters)
        group = lambda at, k: lambda all_: F.slice(paragraphs, at, F.coalesce(F.get(all_, k + 1), F.size(paragraphs) + 1) - at)
        return text.bound(places, lambda all_: F.transform(all_, lambda at, k: text.js_trim(F.array_join(group(at, k)(all_), "\n\n"))))

    sections = lambda groups: F.transform(groups, lambda g, k: chapter(k + 1, F.concat(F.lit("Section "), (k + 1).cast("string")), g))
    whole = F.array(chapter(F.lit(1), F.lit("Full Story"), F.col("_t")))
    rest = text.bound(text.bound(own, grouped), lambda groups: F.when(F.size(groups) > 0, sections(groups)).otherwise(whole))
    headed = F.filter(F.transform("_c", lambda c, k: chapter(k + 1, c["heading"], joined(c["lines"]))), lambda c: c["content"] != "")
    # one pass over the texts, whatever they have
    found = fixed(cut, "_c", F.col("_c")).select(key, F.explode(F.when(F.size("_c") > 0, headed).otherwise(rest)).alias("_c"))
    return found.select(key, "_c.*")


def next_numbers(heads: Column) -> Column:
    """Of the heads (see cut_at) those numbered 1, 2, 3..., each the first after the one before; the first line stays, with any other number as no heading."""
    bare = F.struct(F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("first"))

    def step(state: Column, h: Column) -> Column:
        counts = F.coalesce(h["heading"]["number"] == state["n"] + 1, F.lit(False))
        kept = F.when(counts, F.concat(state["kept"], F.array(h))).when(h["heading"]["first"], F.concat(state["kept"], F.array(F.struct(h["at"].alias("at"), bare.alias("heading"))))).otherwise(state["kept"])
        return F.struct((state["n"] + F.when(counts, 1).otherwise(0)).alias("n"), kept.alias("kept"))

    return F.aggregate(heads, F.struct(F.lit(0).alias("n"), F.slice(heads, 1, 0).alias("kept")), step)["kept"]


NUMBERED = "(?i)^(?:#{1,6}\\s*)?(?:chapter\\s*)?(\\d{1,9})\\s*[-:.)]\\s*(\\S.*)$"


def numbered_chapters(rows: DataFrame, key: str = "doc_id", in_order: bool = False) -> DataFrame:
    """(key, number, title, content) of chapters below lines like "3. Title"; what stands before the first is chapter 1, but for
    its first line, which stands for its heading. With ``in_order`` chapters are numbered 1, 2, 3...: a line with any number but the
    next one ("187.231.175", "12:30") is text."""

    def heading(x: Column) -> Column:
        bare = F.regexp_replace(x["line"], "\\s+$", "")
        good = bare.rlike(NUMBERED)
        told = F.struct(F.when(good, F.regexp_extract(bare, NUMBERED, 1).cast("int")).alias("number"), F.when(good, text.js_trim(F.regexp_extract(bare, NUMBERED, 2))).alias("title"), x["first"].alias("first"))
        return F.when(good | x["first"], told)

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # the first line that says something stands for a heading, if it is none
    begun = F.transform(lines, lambda line: text.js_trim(line) != "")
    first = F.array_position(begun, True).cast("int")
    both = rows.select(key, lines.alias("_l"), first.alias("_first"))
    tagged = F.transform("_l", lambda line, k: F.struct(line.alias("line"), (k + 1 == F.col("_first")).alias("first")))
    cut = cut_at(tagged, heading, next_numbers if in_order else None)
    found = both.select(key, F.explode(cut).alias("_c"))
    number, title = F.coalesce("_c.heading.number", F.lit(1)).alias("number"), F.coalesce("_c.heading.title", F.lit("Chapter 1")).alias("title")
    return found.select(key, number, title, joined(F.transform("_c.lines", lambda x: x["line"])).alias("content"))


ANY = "(?i)^(?:(?:chapter|sura(?:[ \\t]+ya)?|part|section)[ \\t]+[0-9a-z]+\\b|第[0-9一二三四五六七八九十]+[ \\t]*[章卷]|[0-9]+\\.[ \\t]+[a-z])"
#: Words of a part of a text without headings, and the most characters of a title.
PART_WORDS, TITLE_CHARACTERS = 1200, 80


def heading_parts(rows: DataFrame, key: str = "doc_id", size: int = PART_WORDS) -> DataFrame:
    """(key, number, title, content) of parts that begin at heading lines in English, Kiswahili or Chinese, with the text before
    the first; without any, of runs of ``size`` words. A part's first line is its title; a part of one line has it as content too."""
    lines = F.split(F.coalesce("text", F.lit("")), "\\r?\\n")
    tagged = F.transform(lines, lambda line, k: F.struct(line.alias("line"), k.alias("k")))
    cut = cut_at(tagged, lambda x: F.when((x["k"] == 0) | x["line"].rlike(ANY), x["line"]))
    parts = F.filter(F.transform(cut, lambda c: text.js_trim(F.concat(c["heading"], F.lit("\n"), F.array_join(F.transform(c["lines"], lambda x: x["line"]), "\n")))), lambda p: p != "")
    found = rows.select(key, F.col("text"), (F.size(cut) > 1).alias("_headed"), parts.alias("_p"))
    placed = found.where("_headed").select(key, F.posexplode("_p").alias("_k", "_p"))
    head, body = F.regexp_extract("_p", "^([^\\n]*)", 1), F.regexp_extract("_p", "(?s)^[^\\n]*\\n?(.*)$", 1)
    headed = placed.select(key, (F.col("_k") + 1).alias("number"), text.js_trim(F.substring(head, 1, TITLE_CHARACTERS)).alias("title"), F.coalesce(F.nullif(text.js_trim(body), F.lit("")), head).alias("content"))
    from .formatting import word_chunks

    runs = word_chunks(found.where("not _headed").select(key, F.coalesce("text", F.lit("")).alias("text")), key, size)
    rest = runs.select(key, F.col("chunk").cast("int").alias("number"), F.concat(F.lit("Section "), F.col("chunk").cast("string")).alias("title"), F.col("text").alias("content"))
    return headed.unionByName(rest)


# --- what a manuscript tells of itself


def infer_language(source: Column, name: Column) -> Column:
    """en or sw by a mark of the file name, else by the first kind of chapter lines that the text has; null if none tells."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    told = F.lit(None).cast("string")
    for code, word in (("sw", SURA), ("en", "chapter")):
        told = F.when(source.rlike(f"(?im)^\\s*(?:#{{1,6}}\\s+)?{word}\\s+"), code).otherwise(told)
    for code, other in (("sw", "swahili"), ("en", "english")):
        told = F.when(lower.rlike(f"(?:^|[_\\-.]){code}(?:[_\\-.]|$)|{other}"), code).otherwise(told)
    return told


def lines_above(source: Column) -> Column:
    """Lines above the first chapter line, without a block between rules."""

    def above(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda line: line.rlike("(?i)^(?:#{1,6}\\s+)?(?:chapter|sura(?:\\s+ya)?)\\s+\\S")), True)
        return F.slice(lines, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(lines)).cast("int"))

    return text.bound(F.split(without_front_block(source), "\n"), above)


def infer_title(above: Column, name: Column) -> Column:
    """The first top heading above the chapters, else what the file name says without its marks; initials upper."""
    top = "^#\\s+([^#\\s].*)"
    heading = text.js_trim(F.regexp_extract(F.get(F.filter(above, lambda line: line.rlike(top)), F.lit(0)), top, 1))
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), "(?i)^mobile[_ -]+|\\.(?:md|txt)$", "")
    stem = F.regexp_replace(stem, "(?i)_TOLEO_LILILOPANULIWA$", "")
    stem = F.regexp_replace(stem, "(?i)(?:_final)?_(?:en|sw)(?:_final)?(?:_expanded)?(?:_v\\d+(?:_\\d+)*)?$", "")
    good = heading.isNotNull() & ~heading.rlike("(?i)^(?:chapter|sura(?:\\s+ya)?)\\b")
    return initials(F.when(good, F.lower(heading)).otherwise(F.replace(stem, F.lit("_"), F.lit(" "))))


def initials(c: Column) -> Column:
    """The first letter of each word upper, the others as they are."""
    parts = F.split(c, "(?<![\\p{L}\\p{N}_])(?=\\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def infer_author(above: Column) -> Column:
    """A labelled author above the chapters, else the first second-level heading, if it has at most five words."""
    label = "(?i)^\\s*(?:\\*{1,2}|_{1,2})?(?:author|mwandishi)\\s*:\\s*(.+?)(?:\\*{1,2}|_{1,2})?\\s*$"
    second = "^##\\s+([^#]+)$"
    labelled = text.js_trim(F.regexp_extract(F.get(F.filter(above, lambda line: line.rlike(label)), F.lit(0)), label, 1))
    byline = text.js_trim(F.regexp_extract(F.get(F.filter(above, lambda line: line.rlike(second)), F.lit(0)), second, 1))
    return F.coalesce(labelled, F.when(text.word_count(byline) <= 5, byline))


def described(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, language, title, author) that manuscripts (key, name, text) tell by their names and texts."""
    source = F.coalesce("text", F.lit(""))
    both = rows.select(key, "name", infer_language(source, F.col("name")).alias("language"), lines_above(source).alias("_above"))
    return both.select(key, "language", infer_title(F.col("_above"), F.col("name")).alias("title"), infer_author(F.col("_above")).alias("author"))
