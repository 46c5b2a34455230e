"""Signals as data: which of a table of signals a text shows, in one pass for all of them.

A signal is shown by vocabulary terms, which stand between word boundaries, or by phrases, which may stand anywhere, also
inside words. All forms of a table become a few automata: each is one pattern in the form of a prefix tree, looked for
at every place of the text, so the cost of a text does not grow with the number of signals. Forms of which one
begins with the other could both match at one place; they go to different *layers*, and there are as many
automata as layers (two or three as a rule). What is found is a short list of forms, and signals are told from that list.

The table is an object of the driver, like a vocabulary, and comes from fixed values, from rows, or from a table of a checked size.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import SPACE_CLASS, escape
from evisift.operators.phrases import core_of

GLUE = rf"[{SPACE_CLASS}\-_]++"
TERM, PHRASE = "term", "phrase"
#: Most forms of a table that becomes an object.
MOST_FORMS = 100_000
ROWS = "signal string, kind string, form string"


def layers(forms: Iterable[str]) -> list[list[str]]:
    """Forms dealt so that within a layer none begins with another; longer ones come first."""
    out: list[list[str]] = []
    depth: dict[str, int] = {}
    for form in sorted(set(forms)):  # a form's beginnings stand before it
        depth[form] = 1 + max((depth[form[:n]] for n in range(1, len(form)) if form[:n] in depth), default=-1)
        while len(out) <= depth[form]:
            out.append([])
        out[depth[form]].append(form)
    return out[::-1]


def tree_pattern(forms: Iterable[str], glue: str | None) -> str:
    """One pattern for forms of which none begins with another; spaces become ``glue``, where given."""
    tree: dict = {}
    for form in forms:
        node = tree
        for char in form:
            node = node.setdefault(char, {})

    def pattern(node: dict) -> str:
        parts = [(glue if char == " " and glue else escape(char)) + pattern(below) for char, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""

    return pattern(tree)


@dataclass(frozen=True)
class SignalTable:
    """``terms`` and ``phrases`` give the forms, in lower case, of each signal; a signal may have either or both."""

    terms: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    phrases: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple[str, str, str]]) -> SignalTable:
        """From ``(signal, kind, form)``; a term needs a letter or digit, a phrase any character."""
        found: dict[str, dict[str, dict[str, None]]] = {TERM: {}, PHRASE: {}}
        for signal, kind, form in rows:
            if kind not in found:
                raise ValueError(f"a form is a {TERM} or a {PHRASE}, not {kind!r}")
            if not form or (kind == TERM and not any("a" <= c <= "z" or "0" <= c <= "9" for c in form.lower())):
                raise ValueError(f"nothing to look for: {form!r}")
            found[kind].setdefault(signal, {})[form.lower()] = None
        return cls(*({s: tuple(forms) for s, forms in found[kind].items()} for kind in (TERM, PHRASE)))

    @classmethod
    def from_table(cls, table: DataFrame, most: int = MOST_FORMS) -> SignalTable:
        """From a table ``(signal, kind, form)`` of at most ``most`` rows."""
        rows = table.select("signal", "kind", "form").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"signal table has more than {most} forms")
        return cls.of(sorted(map(tuple, rows)))

    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *self.phrases]))

    def found(self, lowered: Column) -> Column:
        """``struct<terms, phrases>``: the forms that stand in a text in lower case."""
        def hits(layer: list[str], glue: str | None, bounded: bool) -> Column:
            body = f"({tree_pattern(layer, glue)})"
            wanted = f"(?<![a-z0-9]){body}(?![a-z0-9])" if bounded else body
            return F.regexp_extract_all(lowered, F.lit(f"(?={wanted})"), F.lit(1))

        def merged(parts: list[Column]) -> Column:
            return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")

        terms = {f for forms in self.terms.values() for f in forms}
        # a form with a space matches several texts, which share a core; any other matches itself alone
        plain = {f for f in terms if plain_core(f) == f}
        exact = {f for f in terms - plain if " " not in f}
        parts = [F.transform(hits(layer, GLUE, True), core_of) for layer in layers(plain)]
        parts += [hits(layer, None, True) for layer in layers(exact)]
        parts += [
            F.array_compact(F.array(F.when(F.size(hits([form], GLUE, True)) > 0, F.lit(form)))) for form in sorted(terms - plain - exact)
        ]
        phrases = layers({f for forms in self.phrases.values() for f in forms})
        return F.struct(merged(parts).alias("terms"), merged([hits(layer, None, False) for layer in phrases]).alias("phrases"))

    def shows(self, found: Column, signal: str) -> Column:
        """Whether a signal is among the forms that were found."""
        shown = F.lit(False)
        for forms, part in ((self.terms, "terms"), (self.phrases, "phrases")):
            wanted = forms.get(signal, ())
            if wanted:
                shown = shown | F.arrays_overlap(found[part], F.array(*map(F.lit, wanted)))
        return shown


def plain_core(form: str) -> str:
    """What :func:`core_of` makes of a form."""
    out = []
    for char in form.lower():
        glue = char in "-_" or char.isspace()
        if not glue:
            out.append(char)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)
