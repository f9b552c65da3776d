"""A variable of one seed carried into another by a bridge statement."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as X
from .pairing import weighted_occurrences


def chosen(groups: Column, seed: int, id: Column, what: str, largest: bool) -> Column:
    """A name of a drawn group, or of the first of the largest ones; null without groups."""
    drawn = lambda items, part: F.get(items, X.drawn_of(F.size(items), seed, F.concat_ws("|", id, F.lit(what), F.lit(part))))
    most = F.get(F.filter(groups, lambda g: F.size(g) == F.array_max(F.transform(groups, F.size))), F.lit(0))
    group = most if largest else F.when(F.size(groups) > 0, drawn(groups, "group"))
    return F.when(F.size(group) > 0, drawn(group, "name"))


def each_alone(names: Column) -> Column:
    """The lightweight mode's groups: every scanned variable is one of its own."""
    return F.transform(F.array_distinct(names), lambda n: F.array(n))


def dataflow_bridges(pairs: DataFrame, seeds: DataFrame, seed: int, largest: bool = False, name: str = "fusion", tag: str | None = None, statement: str = "{name} = {value}") -> DataFrame:
    """(id_lo, id_hi, var_a, var_b, n, bridged): the first content, a statement that gives the bridge the value of one of its
    variables, and the second content, in which n drawn occurrences of one of its variables are the bridge.

    seeds: (id, content, groups), groups of names that flow together. n is 1, 2 or 3 with weights 89, 10 and 1, and no more
    than there are. A side without groups leaves both as they are, one behind the other. A tag is a comment that ends the
    statement.
    """
    a, b = (seeds.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "content", "groups"))) for p in "ab")
    pair = F.concat_ws("-", "id_lo", "id_hi")
    met = pairs.join(a, F.col("id_lo") == F.col("a_id")).join(b, F.col("id_hi") == F.col("b_id")).withColumns({"var_a": chosen(F.col("a_groups"), seed, pair, "a", largest), "var_b": chosen(F.col("b_groups"), seed, pair, "b", largest)})
    both = F.col("var_a").isNotNull() & F.col("var_b").isNotNull()
    there = F.regexp_count("b_content", F.concat(F.lit(r"(?<!\w)\Q"), "var_b", F.lit(r"\E(?!\w)")))
    counted = met.withColumn("n", F.when(both, weighted_occurrences(seed, pair, there)).otherwise(0).cast("int")).withColumn("key", F.concat_ws("|", F.lit(str(seed)), pair))
    put = X.Scan(lambda text, old, n, key: X.replace_words(text, old, name, n, key) if n else text, "string", pa.string())
    replaced = X.scanned(counted.select("id_lo", "id_hi", "a_content", "b_content", "var_a", "var_b", "n", "key"), text=(put, "b_content", "var_b", "n", "key"))
    before, after = statement.replace("{name}", name).split("{value}")
    line = F.concat(F.lit(before), "var_a", F.lit(after + (f"  {tag}" if tag else "")), F.lit("\n"))
    made = F.concat("a_content", F.lit("\n"), F.when(both, line).otherwise(""), "text")
    return replaced.select("id_lo", "id_hi", F.when(both, F.col("var_a")).alias("var_a"), F.when(both, F.col("var_b")).alias("var_b"), "n", made.alias("bridged"))
