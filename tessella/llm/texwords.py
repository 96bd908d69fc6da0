"""Words of a TeX article as a reader sees them, for matching against plain text.

Words are runs of letters and digits in lower case.  Commands are no words and don't part their neighbours; keys of
citations, references, labels and index entries are dropped; accents written as commands become letters, ``\\-``
vanishes, macros that the text defines are replaced by their bodies, and comments count as text.
"""

from __future__ import annotations

import re
import unicodedata

word_runs = re.compile(r"[^\W_]+").findall

#: Combining marks of TeX's accent commands, and letters that have commands of their own.
MARKS = {
    '"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307",
    "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331",
}
LETTERS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å",
    "i": "ı", "j": "ȷ",
}

_defines = re.compile(r"\\(?:(?:re|provide)?newcommand|g?def)(?![A-Za-z])").search
_JOIN = "\ue000"  # stands before a letter made from an accent command, until its braces are gone
_command = re.compile(
    r"\\(?:(?P<hyphen>-)"
    r"|(?P<sign>[\"'`^~=.])\s*(?:\{\s*(?P<s1>\\[ij](?![A-Za-z])|[^\W\d_])\s*\}|(?P<s2>\\[ij](?![A-Za-z])|[^\W\d_]))"
    r"|(?P<name>[cvuHkrdb])(?:\s*\{\s*(?P<n1>\\[ij](?![A-Za-z])|[^\W\d_])\s*\}|\s+(?P<n2>\\[ij](?![A-Za-z])|[^\W\d_]))"
    r"|(?P<keyed>(?:cite|citet|ref|eqref|label|index)(?![A-Za-z])\*?\s*(?P<note>(?:\[[^\]]*\]\s*)*)\{[^{}]*\})"
    r"|(?P<letter>ss|ae|AE|oe|OE|o|O|l|L|aa|AA|i|j)(?![A-Za-z])(?:\{\}|[ \t]+(?=[^\W\d_]))?"
    r"|[A-Za-z@]+\*?|.)",
    re.S,
)
_joined = re.compile(r"\{" + _JOIN + r"(.)\}", re.S)
_definition = re.compile(
    r"\\(?:(?:re|provide)?newcommand\*?\s*(?:\{\s*\\([A-Za-z@]+)\s*\}|\\([A-Za-z@]+))\s*(?:\[(\d)\])?(?:\[[^\]]*\])?"
    r"|g?def\s*\\([A-Za-z@]+)\s*((?:#\d)*))\s*\{"
)


def _accented(m: re.Match) -> str:
    kind = m.lastgroup if m.lastgroup not in ("s1", "s2", "n1", "n2", "note") else None
    if kind == "hyphen":
        return ""
    mark = m["sign"] or m["name"]
    if mark:
        letter = (m["s1"] or m["s2"] or m["n1"] or m["n2"]).lstrip("\\")
        return _JOIN + unicodedata.normalize("NFC", letter + MARKS[mark])
    if m["keyed"]:
        return " " + m["note"]
    if m["letter"]:
        return _JOIN + LETTERS[m["letter"]]
    return " "


_braces = re.compile(r"\\.|[{}]", re.S)
_parameter = re.compile(r"#(\d)")
_token = re.compile(r"\\(?:[A-Za-z@]+|.)|.", re.S)
#: Stands between passages that aren't neighbours: a word that no item holds.
BREAK = "ꙮ" * 3


def _closings(text: str) -> dict[int, int]:
    """The place after each opening brace, to the place of the brace that closes it; open groups are left out."""
    open_, out = [], {}
    for m in _braces.finditer(text):
        if m[0] == "{":
            open_.append(m.end())
        elif m[0] == "}" and open_:
            out[open_.pop()] = m.start()
    return out


def macros(text: str, closings: dict[int, int] | None = None) -> dict[str, tuple[int, str]]:
    """Macros that the text defines: name to number of arguments and body; the last definition counts.

    The body of a group that is never closed, as in a cut-off file, goes on to the text's end.
    """
    closings = _closings(text) if closings is None else closings
    out = {}
    for m in _definition.finditer(text):
        name = m[1] or m[2] or m[4]
        out[name] = (int(m[3] or 0) if m[4] is None else m[5].count("#"), text[m.end() : closings.get(m.end(), len(text))])
    return out


def _reached(known: dict[str, tuple[int, str]], use: re.Pattern) -> dict[str, set[str]]:
    """Each macro with all macros that its body uses, directly or through others."""
    direct = {name: {m[1] for m in use.finditer(body)} for name, (_, body) in known.items()}
    out = {}
    for name in known:
        seen, stack = set(), list(direct[name])
        while stack:
            other = stack.pop()
            if other not in seen:
                seen.add(other)
                stack += out[other] - seen if other in out else direct[other]
        out[name] = seen
    return out


def _ends_in_command(text: str) -> bool:
    name = len(text)
    while name and (text[name - 1].isascii() and text[name - 1].isalpha() or text[name - 1] == "@"):
        name -= 1
    slashes = name
    while slashes and text[slashes - 1] == "\\":
        slashes -= 1
    return name < len(text) and (name - slashes) % 2 == 1


class _Frame:
    """A stretch of text at work: its place, what is done of it, and the macro use at hand with its arguments."""

    def __init__(self, text: str, closings: dict[int, int], at: int, end: int, owner: str | None = None, key: tuple | None = None):
        self.text, self.closings, self.at, self.end, self.owner, self.key = text, closings, at, end, owner, key
        self.parts: list[str] = []
        self.use: str | None = None
        self.left: list[tuple[int, int]] = []
        self.done: list[str] = []

    def add(self, value: str) -> None:
        """Append what a use stands for; its letters are no part of a command's name before it, nor those after it of one at its end."""
        if value and self.parts and _ends_in_command(self.parts[-1]):
            self.parts.append(" ")
        self.parts.append(value + " " if _ends_in_command(value) else value)


class _Expansion:
    """Macro uses of one text replaced by what they stand for.

    Arguments come first, then the body; equal uses are worked out once.  What a macro uses of itself, directly or
    through others, is a plain command.  What a use stands for is kept whole up to ``2 * keep`` words; of a longer one
    its first and last ``keep`` words stand in the text, and the whole is put ``aside`` once.  So every run of at most
    ``keep`` words is met, and no chain of macros makes the text grow beyond ``2 * keep`` words a use.
    """

    def __init__(self, known: dict[str, tuple[int, str]], keep: int):
        self.known, self.keep = known, keep
        self.use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")(?![A-Za-z@])")
        self.reached = _reached(known, self.use)
        self.values: dict[tuple, str] = {}
        self.aside: list[str] = []

    def of(self, text: str, closings: dict[int, int]) -> str:
        """The text expanded; by a stack of its own, so that no depth is too deep."""
        defined = {m.start(k) - 1 for m in _definition.finditer(text) for k in (1, 2, 4) if m[k]}
        frames = [_Frame(text, closings, 0, len(text))]
        while True:
            f = frames[-1]
            if f.use is not None:
                if f.left:
                    frames.append(_Frame(f.text, f.closings, *f.left.pop(), f.owner))
                    continue
                key = (f.use, *f.done)
                if key in self.values:
                    f.add(self.values[key])
                    f.use = None
                else:
                    body = _parameter.sub(lambda m: f.done[int(m[1]) - 1] if 0 < int(m[1]) <= len(f.done) else m[0], self.known[f.use][1])
                    frames.append(_Frame(body, _closings(body), 0, len(body), f.use, key))
                continue
            m = self.use.search(f.text, f.at, f.end)
            if m is None:
                f.parts.append(f.text[f.at : f.end])
                value = "".join(f.parts)
                frames.pop()
                if not frames:
                    return value
                if f.key is not None:
                    self.values[f.key] = self._bounded(value)
                else:
                    frames[-1].done.append(value)
                continue
            f.parts.append(f.text[f.at : m.start()])
            spans, after = self._arguments(f.text, f.closings, m.end(), f.end, self.known[m[1]][0])
            recursive = f.owner is not None and (f.owner == m[1] or f.owner in self.reached[m[1]])
            if recursive or spans is None or (len(frames) == 1 and m.start() in defined):
                # a macro within itself, one with an argument that is never closed, and the name of a definition stay
                # as they are, so that no text is lost
                f.parts.append(" " if recursive else m[0])
                f.at = m.end()
            else:
                f.use, f.left, f.done, f.at = m[1], spans[::-1], [], after

    @staticmethod
    def _arguments(text: str, closings: dict[int, int], at: int, end: int, n: int) -> tuple[list[tuple[int, int]] | None, int]:
        """Spans of the ``n`` arguments from ``at`` on, and the place after them; None if one isn't closed."""
        spans = []
        for _ in range(n):
            while at < end and text[at] in " \t\n":
                at += 1
            if at < end and text[at] == "{":
                stop = closings.get(at + 1)
                if stop is None or stop >= end:
                    return None, at
                spans.append((at + 1, stop))
                at = stop + 1
            else:
                m = _token.match(text, at, end)
                spans.append((at, m.end() if m else at))
                at = spans[-1][1]
        return spans, at

    def _bounded(self, value: str) -> str:
        if len(value) <= 4 * self.keep:
            return value
        read = _read(value)
        # a word longer than any item's equals none, so its rest doesn't matter
        words = [w[: self.keep + 1] for w in word_runs(read)]
        if len(words) <= 2 * self.keep:
            inner = " ".join(words)
        else:
            self.aside.append(" ".join(words))
            inner = " ".join([*words[: self.keep], BREAK, *words[-self.keep :]])
        return ("" if word_runs(read[:1]) else " ") + inner + ("" if word_runs(read[-1:]) else " ")


def expand(text: str, keep: int = 1_000) -> str:
    """The text with its own macros replaced; see ``_Expansion`` for what ``keep`` bounds."""
    closings = _closings(text)
    known = macros(text, closings)
    if not known:
        return text
    expansion = _Expansion(known, keep)
    main = expansion.of(text, closings)
    return f" {BREAK} ".join([main, *expansion.aside])


def _read(text: str) -> str:
    """The text with its commands read: accents as letters, keys dropped, other commands as spaces."""
    if "\\" in text:
        text = _command.sub(_accented, text)
        if _JOIN in text:
            text = _joined.sub(r"\1", text).replace(_JOIN, "")
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def tex_words(text: str | None, keep: int = 1_000) -> list[str]:
    """Lower-case words of a TeX text; none for an empty or missing one.

    Every run of at most ``keep`` words of the text with its macros expanded is a run of the result.
    """
    if not text:
        return []
    if "\\" in text and _defines(text):
        text = expand(text, keep)
    return word_runs(_read(text).lower())
