"""Font classes, styles and stand-ins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts of font classes, in the order they are asked.
CLASSES = (
    ("symbol", "symbol|wingding|zapf|dingbat|webding"),
    ("mono", "courier|consola|mono|fixed|typewriter|cour"),
    ("serif", "times|georgia|garamond|palatino|book|roman|serif|cambria|tiro|minion|caslon|baskerville"),
)
# Stand-in fonts by class: plain, italic, bold, bold italic.
STAND_INS = {"mono": "cour coit cobo cobi", "serif": "tiro tiit tibo tibi", "sans": "helv heit hebo hebi"}


def font_class(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for cls, parts in CLASSES:
        out = (F.when if out is None else out.when)(low.rlike(parts), cls)
    return out.otherwise("sans")


def is_bold(name: Column, flags: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("bold|black|heavy") | (flags.bitwiseAND(1 << 18) != 0)


def is_italic(name: Column, flags: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("italic|oblique") | (flags.bitwiseAND(1 << 1) != 0)


def stand_in(name: Column, flags: Column) -> Column:
    cls = font_class(name)
    k = is_italic(name, flags).cast("int") + is_bold(name, flags).cast("int") * 2
    out = F.when(cls == "symbol", "symb")
    for c, codes in STAND_INS.items():
        out = out.when(cls == c, F.get(F.array(*map(F.lit, codes.split())), k))
    return out


def alias(path: Column) -> Column:
    return F.concat(F.lit("uf"), F.substring(F.md5(F.lower(path)), 1, 10))
