"""Readings of a hand-typed marker name: what is left when tags, remarks and ways of writing are taken off."""

from __future__ import annotations

import re
import unicodedata

#: Greek letters as members of a family, by name and sign.
GREEK = dict(zip("αβγδεζηθικλμ", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()))
ROMAN = dict(zip("i ii iii iv v vi vii viii ix x xi xii".split(), map(str, range(1, 13))))
#: Texts that stand for no name.
EMPTY = {"", "n/a", "none", "null", "nan", "unknown", "-", "--", "?", "??", "???", "tbd", "to be named"}

_member = r"(?:\d+|[ivx]+|[α-μ]|" + "|".join(GREEK.values()) + ")"
_tags = [
    re.compile(p, re.I)
    for p in (
        r":\s*(?:cyc|ch).*$",  # imaging cycle and channel
        r"\s+-\s+.*$",  # a remark after a spaced dash
        rf"\s*\((?!{_member}\)\s*$)[^()]*\)\s*$",  # clone, dye or isotope in brackets, but not a member number
        r"\s*\[[^\[\]]*\]\s*$",
        r"\s+rep\s*\d+\s*$",
        r"\s+(?:protein|antibody)\s*$",
    )
]
_isotope = re.compile(r"^\d{2,3}[A-Z][a-z]?[_\-\s]+")
_raised = re.compile(r"^anti[\s\-_]+|^a-", re.I)
_phospho = re.compile(r"^phospho[\s\-_]*|^p[\-_]", re.I)
_bare_p = re.compile(r"^p(?=[A-Z])")
_last = re.compile(rf"^(.*?)[\s\-_.]*\(?\s*({_member})\s*\)?$", re.I)
_first = re.compile(rf"^({'|'.join(GREEK.values())}|[α-μ])[\s\-_.]+(.+)$", re.I)
_id = re.compile(r"^([a-z]+)[\s:_\-.]*(\d+)$", re.I)


def plain(value: str) -> str:
    """Compatibility forms, invisible characters, dashes and white space made plain."""
    value = unicodedata.normalize("NFKC", value)
    value = "".join(c for c in value if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n")
    value = re.sub(r"[‐-―−]", "-", value)
    return re.sub(r"\s+", " ", value).strip()


def bare_names(value: str | None) -> list[str]:
    """The names that a typed value may hold, most literal first; none for a stand-in."""
    if value is None:
        return []
    value = plain(value)
    if value.lower() in EMPTY:
        return []
    out: list[str] = []
    for part in re.split(r"\s/\s", value):
        stages = [part]
        while True:
            for tag in _tags:
                shorter = tag.sub("", stages[-1]).strip()
                if shorter != stages[-1]:
                    break
            else:
                break
            stages.append(shorter)
        name = stages[-1]
        for prefix in (_isotope, _raised):
            name = prefix.sub("", name).strip()
        out += [name, _phospho.sub("", name).strip(), _bare_p.sub("", name)]
    return [n for n in dict.fromkeys(out) if n]


def split_member(name: str) -> list[tuple[str, str]]:
    """Stem (letters and digits, lower case) and member of a name, in each way it can be read."""
    out = []
    m = _last.match(name)
    if m and m[1]:
        member = m[2].lower()
        separate = name[len(m[1]) : len(m[1]) + 1] in " -_.(" or member.isdigit() or member in GREEK
        member = GREEK.get(member) or ROMAN.get(member) or (str(int(member)) if member.isdigit() else member)
        if separate:
            out.append((key(m[1]), member))
    m = _first.match(name)
    if m:
        out.append((key(m[2]), GREEK.get(m[1].lower()) or m[1].lower()))
    out.append((key(name), ""))
    return out


def key(name: str) -> str:
    """Letters and digits alone, in lower case."""
    return "".join(c for c in name.lower() if c.isalnum())


def id_key(name: str) -> str | None:
    """Prefix and number of an identifier, without leading zeros."""
    m = _id.match(name)
    return f"{m[1].lower()}:{int(m[2])}" if m else None
