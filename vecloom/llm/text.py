"""From LaTeX-like sources to plain words, whatever the source does to them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: How many times longer the uses of one macro may make a text.
SWOLLEN = 100
#: Commands whose argument is no running text.
_KEYS = re.compile(r"\\(?:label|ref|eqref|pageref|cite[a-z]*|bibitem|includegraphics|input|include|usepackage|documentclass|begin|end)\*?\s*(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?")
_ACCENT = re.compile(r"\\[\"'`^~=.](?:\{\\?([a-zA-Z])\}|\\?([a-zA-Z]))")
_MACRO = re.compile(r"\\(?:(?:re)?newcommand|providecommand|def)\*?\s*\{?\\([a-zA-Z]+)\}?\s*\{([^{}\\#]*)\}")
_WRAPPED = re.compile(r"([a-z]+)-[ \t]*\r?\n[ \t]*%*[ \t]*([a-z]+)")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])
_WORD = re.compile(r"[a-z0-9]+")


def expand_macros(text: str) -> str:
    """Replace macros without arguments that stand for plain words."""
    for name, body in _macros(text):
        text = _use(name).sub(lambda _, b=body: b, text)
    return text


def _macros(text: str) -> list[tuple[str, str]]:
    """Macros of any length, in order of their names' first definition; the last definition of a name holds.

    One whose uses would make the text over ``SWOLLEN`` times as long stays a command: its words are read where it is defined.
    """
    found = [(name, body) for name, body in dict(_MACRO.findall(text)).items() if body.strip()]
    return [(name, body) for name, body in found if len(body) * text.count(f"\\{name}") <= SWOLLEN * len(text)]


def _use(name: str) -> re.Pattern:
    return re.compile(rf"\\{name}(?![a-zA-Z])(?:\{{\}})?")


def fold_letters(text: str) -> str:
    """Compatibility forms and accents as plain letters, invisible characters dropped."""
    text = unicodedata.normalize("NFKD", text).translate(_INVISIBLE)
    return text.replace("\u2010", "-").replace("\u2011", "-").replace("ß", "ss")


_MACRO_WORDS = ("\\newcommand", "\\def", "\\providecommand")
_ACCENTS = ("\\\"", "\\'", "\\`", "\\^")
_WRAPS = ("-\n", "-\r", "- \n")


def flatten(text: str) -> str:
    """Lower case, plain letters, no commands, keys, discretionary or invisible hyphens; comments stay as text."""
    if any(w in text for w in _MACRO_WORDS):
        text = expand_macros(text)
    if not text.isascii():
        text = fold_letters(text)
    text = text.replace("\\-", "")
    if any(a in text for a in _ACCENTS):
        text = _ACCENT.sub(lambda m: m[1] or m[2], text)
    return _COMMAND.sub(" ", _KEYS.sub(" ", text)).lower()


def _unwrapped(known) -> Callable:
    return lambda m: m[1] + m[2] if m[1] + m[2] in known else f"{m[1]} {m[2]}"


def words(text: str, known=frozenset()) -> list[str]:
    """The words of ``text``; a word wrapped with a hyphen is one word if ``known`` has it, else two."""
    flat = flatten(text)
    if any(w in flat for w in _WRAPS):
        flat = _WRAPPED.sub(_unwrapped(known), flat)
    return _WORD.findall(flat)


class Traced:
    """A text under the same changes as ``words`` makes, with the stretch of the original each character stands for."""

    def __init__(self, text: str):
        self.text, self.first, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def put(self, pieces: list[tuple[int, int, str | None]]) -> None:
        """Lay the text out anew: stretches as they are (None), or replaced by a string that stands for the whole stretch."""
        first, end, out = [], [], []
        for a, z, new in pieces:
            if new is None:
                first.append(self.first[a:z])
                end.append(self.end[a:z])
                out.append(self.text[a:z])
            elif new:
                first.append(np.full(len(new), self.first[a]))
                end.append(np.full(len(new), self.end[z - 1]))
                out.append(new)
        self.text = "".join(out)
        self.first, self.end = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (first, end))

    def sub(self, pattern: re.Pattern, change: Callable) -> None:
        pieces, at = [], 0
        for m in pattern.finditer(self.text):
            pieces += [(at, m.start(), None), (m.start(), m.end(), change(m))]
            at = m.end()
        if pieces:
            self.put([*pieces, (at, len(self.text), None)])


def word_stretches(text: str, known=frozenset()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, first character, character after the last) in ``text`` itself; the words are those of :func:`words`."""
    t = Traced(text)
    if any(w in text for w in _MACRO_WORDS):
        for name, body in _macros(text):
            t.sub(_use(name), lambda _, b=body: b)
    if not t.text.isascii():
        t.put([(i, i + 1, None if c.isascii() else fold_letters(c)) for i, c in enumerate(t.text)])
    t.sub(re.compile(r"\\-"), lambda _: "")
    t.sub(_ACCENT, lambda m: m[1] or m[2])
    t.sub(_KEYS, lambda _: " ")
    t.sub(_COMMAND, lambda _: " ")
    t.text = t.text.lower()
    if any(w in t.text for w in _WRAPS):
        # both halves keep their own places, so that a word that stays apart does too
        change = _unwrapped(known)
        pieces, at = [], 0
        for m in _WRAPPED.finditer(t.text):
            pieces += [(at, m.end(1), None), (m.end(1), m.start(2), " " if " " in change(m) else ""), (m.start(2), m.end(2), None)]
            at = m.end()
        t.put([*pieces, (at, len(t.text), None)])
    met = list(_WORD.finditer(t.text))
    return [m[0] for m in met], np.array([t.first[m.start()] for m in met], np.int64), np.array([t.end[m.end() - 1] for m in met], np.int64)
