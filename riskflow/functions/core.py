"""Small Column helpers shared by every module (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's ``str.isspace`` accepts, as one regex class that
# Java regex and RE2 read the same way (Java's own ``\s`` is ASCII-only).
WS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}]")


# The same characters as a plain string, for character-set trimming.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (a
    character-set trim; it only touches the ends of the string)."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def map_literal(mapping: Mapping) -> Column:
    """A literal MAP column, for lookups that stay inside codegen."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def pick(values: Iterable, index: Column) -> Column:
    """``values[index]`` for a 0-based integer column (null when out of range)."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def lookup(mapping: Mapping, key: Column, default=None) -> Column:
    found = F.try_element_at(map_literal(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def non_null_array(*items: Column) -> Column:
    """array(items) without its null members, keeping order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def label_array(summary: Column | str, label: str) -> Column:
    """The value list of one label in an entity summary map; empty when absent."""
    return F.coalesce(F.try_element_at(col(summary), F.lit(label)), empty_str_array())


def js_round(c: Column) -> Column:
    """JavaScript ``Math.round`` (halves go up)."""
    return F.floor(c + F.lit(0.5))


def explode_with_pos(df, keep: list, arr: Column, pos: str, value: str):
    """``posexplode`` of an array expression without Spark's inferred
    ``size(arr) > 0`` filter, which would copy (and so evaluate twice) an
    expensive array expression: the outer form plus a null-position filter
    keeps exactly the rows of the non-empty arrays."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, value)).where(F.col(pos).isNotNull())


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once a row, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """ARRAY<INT>: what comes before each element, from 0.  Cut into about root n
    stretches, so n elements cost n times root n, not n squared as one fold does
    that copies its array at every step."""

    def fold(x):
        """Sums before each element, and the total as the last one."""
        return F.aggregate(x, F.array(F.lit(0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))

    def stretches(v, width):
        cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1))
        return F.transform(cuts, lambda k: fold(F.slice(v, k * width + 1, width)))

    def shifted(parts):
        before = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)),
                                    lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: v + b)))

    def sums(v):
        long = let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")), lambda width: let(stretches(v, width), shifted))
        return F.when(F.size(v) <= 64, F.slice(fold(v), 1, F.size(v))).otherwise(long)

    return let(values, sums)
