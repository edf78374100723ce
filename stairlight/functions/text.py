"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the letters of labels, without the one that looks like another.
ALPHABET = "ABCDEFGHIJKLMNOPRSTUVWXYZ"


def slug(text: Column) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def positive_number(word: Column) -> Column:
    return word.rlike(r"^[0-9]*\.?[0-9]+$")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def letters(n: Column) -> Column:
    """Label of a 1-based number: bijective numeration in the letters above; up to four letters."""
    base, out, left = len(ALPHABET), F.lit(""), n.cast("long")
    for _ in range(4):
        digit = F.pmod(left - 1, F.lit(base))
        letter = F.substring(F.lit(ALPHABET), (digit + 1).cast("int"), F.lit(1))
        out = F.when(left > 0, F.concat(letter, out)).otherwise(out)
        left = F.when(left > 0, F.floor((left - 1) / base)).otherwise(F.lit(0)).cast("long")
    return out


def box(text: Column, magnify: float = 1.0) -> list[Column]:
    """x1, y1, x2, y2 of a zero-based "x1,y1,x2,y2", made 1-based and scaled down, half to even."""
    parts = [F.split(text, ",")[i].cast("int") + 1 for i in range(4)]
    return [F.rint(p / F.lit(float(magnify))).cast("int") if magnify > 1 else p for p in parts]
