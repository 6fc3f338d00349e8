"""Column helpers for text. Patterns spell out Unicode classes, so that Java, RE2 and Python read them alike."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SEPARATORS = r"[\s\x0b\x1c-\x1f\x85\p{Z}\p{Nd}\-–—:|]"
EDGE_MARKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}\-–—:|]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # all that SPACE fits
PUNCTUATION = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"
HEADER_LINE = rf"\A{SPACE}*#{{1,4}}{SPACE}+[^\s\x0b\x1c-\x1f\x85\p{{Z}}]"
CAPTION = rf"(?i)\A{SPACE}*table{SPACE}+\p{{Nd}}+(?:[-.]\p{{Nd}}+)?[:.]?{SPACE}*"
HYPHEN_END = rf"-{SPACE}*\z"
SENTENCE_END = rf'[.!?"]{SPACE}*\z'
MONO_FONT = "courier|mono|consolas|fixed"


def replaced(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def strip(text: Column) -> Column:
    """White space off both ends, by Python's idea of it; a pattern would look through the whole text."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Lower case, punctuation to spaces, runs of white space to one space, stripped; underscores stay."""
    return strip(replaced(replaced(F.lower(text), PUNCTUATION, " "), f"{SPACE}+", " "))


def strip_digits(text: Column) -> Column:
    """Leading and trailing digits, separators and white space taken off."""
    return strip(replaced(replaced(text, rf"\A{SEPARATORS}+"), rf"{SEPARATORS}+\z"))


def ends_with_hyphen(text: Column) -> Column:
    return text.rlike(HYPHEN_END)


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def is_header_line(line: Column) -> Column:
    """A Markdown header of one to four marks."""
    return line.rlike(HEADER_LINE)


def strip_caption(text: Column) -> Column:
    """The text without a leading ``Table N``; the empty string if nothing is left."""
    return F.when(text.rlike(CAPTION), strip(replaced(text, CAPTION))).otherwise(text)


def letters(text: Column) -> Column:
    return F.length(replaced(text, r"[^\p{L}]"))


def before_pipe(line: Column) -> Column:
    return F.substring_index(line, "|", 1)


def after_pipe(line: Column) -> Column:
    return F.when(line.contains("|"), F.substring(line, F.instr(line, "|") + 1, F.length(line)))


def is_pipe_candidate(line: Column) -> Column:
    """Whether a line may hold a running header around a pipe; table rows and rules may not."""
    bare = strip(line)
    rule = (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2) & line.rlike(rf"---|\|{SPACE}*-{{2,}}")
    return (
        F.when(~line.contains("|") | (bare == "") | bare.startswith("|") | rule, False)
        .when(line.rlike(rf"\|{SPACE}*\p{{Nd}}+(?:{NOT_WORD}|\z)") | line.rlike(rf"\A{SPACE}*\p{{Nd}}+{SPACE}*\|"), True)
        .otherwise((letters(before_pipe(line)) >= 3) | (letters(after_pipe(line)) >= 3))
    )


def matches_seen(title: Column, seen: Column) -> Column:
    """Whether a normalized title is one of an array, or holds or is held by one, where both have ten characters or more."""
    alike = lambda h: (h == title) | ((F.least(F.length(h), F.length(title)) >= 10) & (F.contains(h, title) | F.contains(title, h)))
    return (title != "") & F.exists(seen, alike)


def header_pattern(header: Column) -> Column:
    """A pattern for the words of a normalized title with anything but words between them."""
    return F.array_join(F.split(header, " "), f"{NOT_WORD}*")


def strip_header_prefix(text: Column, header: Column) -> Column:
    return F.when(header != "", F.regexp_replace(text, F.concat(F.lit(rf"(?iu)\A{SPACE}*"), header_pattern(header)), F.lit(""))).otherwise(text)
