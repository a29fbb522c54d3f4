"""Chapters of manuscripts line by line, one document at a time: what the column expressions must equal."""

import re

#: Kiswahili and English numbers as words.
ENGLISH = dict(zip("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(1, 20), strict=True))
ENGLISH_TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
KISWAHILI = dict(zip("moja mbili tatu nne tano sita saba nane tisa kumi".split(), range(1, 11), strict=True)) | {"kwanza": 1, "pili": 2}
KISWAHILI_TENS = dict(zip("kumi ishirini thelathini arobaini hamsini sitini sabini themanini tisini".split(), range(10, 100, 10), strict=True))


# --- marked chapters in English and Kiswahili


def chapter_number(words: str, language: str) -> int | None:
    """The number that digits or words give, up to one hundred."""
    plain = " ".join(re.sub("[-–—]", " ", words.lower()).split())
    if plain.isdecimal():
        return int(plain)
    units, tens, hundred, link = (ENGLISH, ENGLISH_TENS, "one hundred", " ") if language == "en" else (KISWAHILI, KISWAHILI_TENS, "mia moja", " na ")
    if plain == hundred:
        return 100
    if plain in units or plain in tens:
        return units.get(plain, tens.get(plain))
    head, _, tail = plain.partition(link)
    if head in tens and units.get(tail, 10) < 10:
        return tens[head] + units[tail]
    return None


_MARK = re.compile(r"(?i)(#{1,6}\s+)?(chapter|sura(?:\s+ya)?)\s+(.+)")


def chapter_heading(line: str) -> tuple[int, str, str] | None:
    """(number, title, language) of a chapter line. Without a heading mark it needs a delimiter.

    The number is the longest beginning that reads as one, so hyphenated numbers count whole.
    """
    found = _MARK.fullmatch(line.strip())
    if not found:
        return None
    language, rest = "en" if found[2].lower() == "chapter" else "sw", found[3].strip()
    cuts = [(m.start(), m.end()) for m in re.finditer(r"\s*[:：–—-]\s*", rest)]
    options = [(rest[:a], rest[b:]) for a, b in reversed(cuts)] + [(rest, "")] * (not cuts)
    spaced = re.fullmatch(r"(\d+)\s+(.+)", rest)
    if spaced:
        options.append((spaced[1], spaced[2]))
    options.append((rest, ""))
    for number, title in [(rest, ""), *options]:
        value = chapter_number(number, language)
        if value:
            return (value, title.strip(), language) if found[1] or cuts else None
    return None


def marked_chapters(source: str) -> list[tuple[int, str, str]]:
    """(number, title, content) of each Chapter/Sura section that has content."""
    body = re.sub(r"\A---.*?---\s*", "", re.sub(r"\r\n?", "\n", source), flags=re.S).strip()
    sections: list[tuple[int, str, list[str]]] = []
    for line in body.split("\n"):
        heading = chapter_heading(line)
        if heading:
            number, title, language = heading
            sections.append((number, title or (f"Sura ya {number}" if language == "sw" else f"Chapter {number}"), []))
        elif sections:
            sections[-1][2].append(line)
    return [(number, title, content) for number, title, lines in sections if (content := "\n".join(lines).strip())]


def manuscript_problems(source: str) -> list[str]:
    """Why a manuscript cannot be published: glued headings, no chapters, broken numbering."""
    text = re.sub(r"\r\n?", "\n", source)
    glued = [k for k, line in enumerate(text.split("\n"), 1) if (m := re.search(r"(?i)#{1,6}\s+(?:chapter|sura(?:\s+ya)?)\s+", line)) and m.start() > 0]
    numbers = [n for n, _, _ in marked_chapters(source)]
    return [f"glued heading on line {k}" for k in glued] + (["no chapters"] if not numbers else ["numbers are not 1, 2, ..."] if numbers != list(range(1, len(numbers) + 1)) else [])


def infer_language(source: str, name: str = "") -> str | None:
    for code, other in (("en", "english"), ("sw", "swahili")):
        if re.search(rf"(?:^|[_\-.]){code}(?:[_\-.]|$)|{other}", name.lower()):
            return code
    for code, word in (("en", "chapter"), ("sw", r"sura(?:\s+ya)?")):
        if re.search(rf"(?im)^\s*(?:#{{1,6}}\s+)?{word}\s+", source):
            return code
    return None


def _before_chapters(source: str) -> list[str]:
    """Lines above the first chapter heading, without a block of metadata."""
    text = re.sub(r"\A---.*?---\s*", "", re.sub(r"\r\n?", "\n", source), flags=re.S)
    lines = text.split("\n")
    first = next((k for k, line in enumerate(lines) if re.match(r"(?i)(?:#{1,6}\s+)?(?:chapter|sura(?:\s+ya)?)\s+\S", line)), len(lines))
    return lines[:first]


def _initials(name: str) -> str:
    return re.sub(r"(?<![\w])[^\W\d_]", lambda m: m[0].upper(), name)


def infer_title(source: str, name: str) -> str:
    """The first top heading above the chapters, else what a file name says without its marks."""
    heading = next((m[1].strip() for line in _before_chapters(source) if (m := re.match(r"#\s+([^#\s].*)", line))), None)
    if heading and not re.match(r"(?i)(?:chapter|sura(?:\s+ya)?)\b", heading):
        return _initials(heading.lower())
    stem = re.sub(r"(?i)^mobile[_ -]+|\.(?:md|txt)$", "", name)
    stem = re.sub(r"(?i)_TOLEO_LILILOPANULIWA$", "", stem)
    stem = re.sub(r"(?i)(?:_final)?_(?:en|sw)(?:_final)?(?:_expanded)?(?:_v\d+(?:_\d+)*)?$", "", stem)
    return _initials(stem.replace("_", " "))


def infer_author(source: str) -> str | None:
    """A labelled author above the chapters, else a second-level heading of at most five words."""
    above = _before_chapters(source)
    label = re.compile(r"(?i)\s*(?:\*{1,2}|_{1,2})?(?:author|mwandishi)\s*:\s*(.+?)(?:\*{1,2}|_{1,2})?\s*")
    for line in above:
        if found := label.fullmatch(line):
            return found[1].strip()
    byline = next((m[1].strip() for line in above if (m := re.match(r"##\s+([^#]+)$", line))), None)
    return byline if byline and len(byline.split()) <= 5 else None


_TXT_HEADING = re.compile(r"(?im)^[ \t]*(?:chapter|sura(?:[ \t]+ya)?|section|第)[ \t]*(\d+|[一二三四五六七八九十百]+)[ \t]*[:章.\-]*[ \t]*(.*)$")


def text_chapters(source: str, fallback_chars: int = 3000) -> list[tuple[int, str, str]]:
    """Chapters of a plain text; without headings, paragraphs gathered to ``fallback_chars`` at least."""
    found = list(_TXT_HEADING.finditer(source))
    if found:
        ends = [*(m.start() for m in found[1:]), len(source)]
        return [(k, m[2].strip() or f"Chapter {m[1]}", body) for k, (m, end) in enumerate(zip(found, ends, strict=True), 1) if (body := source[m.end() : end].strip())]
    groups: list[list[str]] = [[]]
    for paragraph in (p for p in re.split(r"\n\s*\n", source) if p.strip()):
        if sum(len(p) + 2 for p in groups[-1]) >= fallback_chars:
            groups.append([])
        groups[-1].append(paragraph)
    out = [(k, f"Section {k}", "\n\n".join(g).strip()) for k, g in enumerate(groups, 1) if g]
    return out or [(1, "Full Story", source)]


_ANY_HEADING = re.compile(r"(?i)(?:(?:chapter|sura(?:[ \t]+ya)?|part|section)[ \t]+[0-9a-z]+\b|第[0-9一二三四五六七八九十]+[ \t]*[章卷]|[0-9]+\.[ \t]+[a-z])")


def heading_chunks(source: str, size: int = 1200) -> list[tuple[int, str, str]]:
    """Parts that begin at heading lines in English, Kiswahili or Chinese; without any, runs of words.

    The first line, cut at 80 characters, is the title; a part of one line has it as its content too.
    """
    lines = re.split(r"\r?\n", source)
    starts = [k for k, line in enumerate(lines) if k and _ANY_HEADING.match(line)]
    if starts:
        parts = ["\n".join(lines[a:b]).strip() for a, b in zip([0, *starts], [*starts, len(lines)], strict=True)]
        kept = [p.partition("\n") for p in parts if p]
        return [(k, head[:80].strip(), body.strip() or head) for k, (head, _, body) in enumerate(kept, 1)]
    words = source.split()
    return [(k, f"Section {k}", " ".join(words[at : at + size])) for k, at in enumerate(range(0, len(words), size), 1)]


_NUMBERED_LINE = re.compile(r"(?i)(?:#{1,6}\s*)?(?:chapter\s*)?(\d+)\s*[-:.)]\s*(\S.*)")


def numbered_chapters(source: str) -> list[tuple[int, str, str]]:
    """Chapters below lines like ``3. Title``; what stands before the first is one of its own."""
    out: list[tuple[int, str, list[str]]] = []
    for line in source.split("\n"):
        found = _NUMBERED_LINE.fullmatch(line.rstrip())
        if found:
            out.append((int(found[1]), found[2].strip(), []))
        elif out:
            out[-1][2].append(line)
        elif line.strip():
            out.append((1, "Chapter 1", []))
    return [(number, title, "\n".join(body).strip()) for number, title, body in out]
