"""Marker names: decoration, keys, spellings, and what a name says about the protein's form.

A name is read as tokens: what stands before the first colon and the first spaced dash, without the imaging cycle at its
end; of that, letters and digits without separators decide whether it names a mark on a histone, an isoform or a
phosphorylated protein.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a cycle with its channel, a histone's mark, an isoform and a phosphorylated protein are written.
CYCLE = r"(?i)[_ ]cyc[a-z]*[_ ]?[0-9]+[_ ]?ch[a-z]*[_ ]?[0-9]+ *$"
MARK = r"(?i)^h?(h[1-4])([kstr][0-9]+)(ac|me[1-3]?|ph|ub)$"
ISOFORM = r"(?i)^(cd[0-9]+)(r[abco])$"
PHOSPHO = r"^([Pp]hospho|p)([A-Z].*)$"
#: Fixed value: a short name that stands for a longer one.
SHORT = {"S6": "RPS6"}


def bare(name: Column) -> Column:
    """The name alone: without a cycle and channel, what follows a colon, and a remark after a spaced dash."""
    line = F.translate(name, "\t\n\r", "   ")
    head = F.substring_index(F.substring_index(line, ":", 1), " - ", 1)
    return F.trim(F.regexp_replace(F.trim(head), CYCLE, ""))


def ascii_key(name: Column) -> Column:
    """Upper-case letters and digits alone."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def variants(name: Column) -> Column:
    """Spellings without dashes, spaces or underscores, and in upper case, as a set."""
    return F.array_distinct(F.array(name, *[F.replace(name, F.lit(c), F.lit("")) for c in "- _"], F.upper(name)))


def form(name: Column) -> Column:
    """A struct of ``core``, ``epitope`` ('pan' if the name names none) and ``modification`` ('none' likewise)."""
    tight = F.translate(name, "-_ ", "")

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(tight, pattern, group)

    def made(core: Column, epitope: Column | str, modification: Column | str) -> Column:
        e, m = (F.lit(x) if isinstance(x, str) else x for x in (epitope, modification))
        return F.struct(core.alias("core"), e.alias("epitope"), m.alias("modification"))

    full = F.lit(None).cast("string")
    for short, long in SHORT.items():
        full = F.coalesce(full, F.when(F.upper(tight) == short, F.lit(long)))
    return (
        F.when(tight.rlike(MARK), made(F.upper(part(MARK, 1)), F.concat(F.upper(part(MARK, 2)), F.lower(part(MARK, 3))), "none"))
        .when(tight.rlike(ISOFORM), made(F.upper(part(ISOFORM, 1)), F.upper(part(ISOFORM, 2)), "none"))
        .when(tight.rlike(PHOSPHO), made(part(PHOSPHO, 2), "pan", "phospho"))
        .otherwise(made(F.coalesce(full, name), "pan", "none"))
    )
