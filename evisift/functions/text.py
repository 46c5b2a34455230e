"""Column functions for text: white space, lines, title case, quality, truncation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, and the line breaks among it, by Unicode code point.
BLANK_CLASS = r"\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
BREAK_CLASS = r"\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
SPACE_CLASS = BLANK_CLASS + BREAK_CLASS
SPACE_CHARS = "".join(
    chr(point)
    for first, last in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
        (0x3000, 0x3000),
    ]
    for point in range(first, last + 1)
)
# The same white space in the short form that Java matches fastest.
SPACES = r"(?U)[\s\x1c-\x1f]+"
WORD = r"(?U)[^\s\x1c-\x1f]+"
RARE_BREAKS = r"\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}-\x{2029}"  # BREAK_CLASS without \n
GLYPH_ARTEFACT = r"\(cid:\p{Nd}+\)|\x00"

# Everyday words that a well separated text is expected to contain.
COMMON_WORDS = (
    "the and for with using built build developed develop experience project projects "
    "skills skill summary education work intern internship engineer engineering software "
    "data machine learning model models system systems application applications web app "
    "design designed implemented implementation created create managed led team tools "
    "technologies technology framework frameworks api backend frontend database server "
    "client user users feature features deployed deployment cloud docker python java "
    "javascript react node analysis analytics platform service services "
    "research presented conference published award awards university institute degree "
    "bachelor master gpa cgpa location email phone linkedin github portfolio personal "
    "details current responsibilities achieved improved reduced increased optimized "
    "testing test tests integration unit performance scalable architecture real time"
).split()
LONG_TOKEN = 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clipped(text: Column, most: int | None) -> Column:
    """The first ``most`` characters; None cuts nothing."""
    return text if most is None else F.left(text, F.lit(most))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    """TRUE for a text without anything but white space: :func:`strip` would leave nothing, at the price of its whole length."""
    return F.length(F.ltrim(text, F.lit(SPACE_CHARS))) == 0


def squeeze(text: Column) -> Column:
    """Strip, and turn inner runs of white space into one space."""
    return F.regexp_replace(strip(text), SPACES, " ")


def split_lines(text: Column) -> Column:
    """The lines of a text; a final line break does not open another line."""
    whole = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.split(whole, "\n")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def escape(literal: str) -> str:
    """Escape a literal for use inside a regular expression."""
    return "".join(c if c.isalnum() or c in " _" or not c.isascii() else "\\" + c for c in literal)


def any_of(literals: Iterable[str]) -> str:
    return "(?:" + "|".join(escape(x) for x in literals) + ")"


#: Most words of a pattern that is a prefix tree.
TREE_WORDS = 2000


def word_tree(words: Iterable[str]) -> str:
    """A pattern for any of these words of letters and digits, as a prefix tree; the shorter of two that begin alike comes last.

    Whoever uses it says what may stand before and behind the word.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [escape(char) + pattern(below) for char, below in sorted(node.items(), reverse=True) if char]
        if "" in node and parts:
            parts.append("")
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return pattern(tree) if tree else "(?!)"


def clean(text: Column) -> Column:
    """Drop glyph artefacts, strip every line and keep at most one blank line in a row."""
    def lines(flat: Column) -> Column:
        return F.array_join(F.transform(F.split(flat, "\n"), strip), "\n")

    dirty = F.contains(text, F.lit("(cid:")) | F.contains(text, F.lit("\x00"))
    bare = F.when(dirty, F.regexp_replace(text, GLYPH_ARTEFACT, " ")).otherwise(text)
    one_break = F.when(text.rlike(f"[{RARE_BREAKS}]"), F.regexp_replace(bare, rf"\r\n|[{BREAK_CLASS}]", "\n")).otherwise(bare)
    return strip(F.regexp_replace(lines(one_break), r"\n{3,}", "\n\n"))


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(text), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 2**30))),
        "",
    )


def quality_hundredths(text: Column) -> Column:
    """How well a text was extracted, in hundredths; -100 when it holds no word.

    Two points per everyday word, 0.05 per token, minus five per over-long token.
    """
    lowered = F.lower(text)
    common = F.size(F.filter(F.split(lowered, "[^a-z]+"), lambda w: w.isin(COMMON_WORDS)))
    tokens = word_count(text)
    glued = F.size(F.filter(F.split(text, SPACES), lambda t: F.length(t) > LONG_TOKEN))
    return (
        F.when(~lowered.rlike("[a-z]{2}"), F.lit(-100))
        .otherwise(common.cast("long") * 200 + tokens.cast("long") * 5 - glued.cast("long") * 500)
        .cast("long")
    )


def clip_words(text: Column, width: int) -> Column:
    """Squeeze, then cut at the last space within ``width`` and mark the cut."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    cut = F.left(flat, F.lit(width))
    at_space = F.regexp_replace(cut, " [^ ]*$", "")
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(at_space, F.lit("…")))


def file_stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=.)\.[^.]+$", "")
