"""Column expressions for text whose rules are those of plain Python strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that strip() and split() treat as white space, and ends of lines.
SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where the pattern does not match. A dot stops at line feeds only."""
    return F.get(all_found(c, pattern, group), F.lit(0))


def all_found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of every match in order; an empty array without matches, null for null."""
    return F.regexp_extract_all(c, F.lit("(?d)" + pattern), F.lit(group))


def lines(c: Column) -> Column:
    """Lines as by splitlines(): no last empty line, none at all for an empty text."""
    return let(F.split(c, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(c: Column) -> Column:
    """Tokens as by split(): runs of anything but white space."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def last_wins(keys: Column, values: Column) -> Column:
    """A map from parallel arrays where a repeated key takes its last value."""
    numbered = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.get(values, i).alias("v"), i.alias("i")))
    rest = F.filter(numbered, lambda p: ~F.array_contains(F.slice(keys, p["i"] + 2, F.size(keys)), p["k"]))
    return F.map_from_arrays(F.transform(rest, lambda p: p["k"]), F.transform(rest, lambda p: p["v"]))


def draw(seed: int, *parts: Column) -> Column:
    """A repeatable random text for sorting: md5 of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))
