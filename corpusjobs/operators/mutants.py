"""Variants of texts. Which rules are tried on a row is drawn in SQL; only rows with a rule are rewritten."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as X
from ..functions import mutations as M


def rules_drawn(seed: Column, language: Column, boost: int = 1) -> Column:
    """The numbers of the rules of a language (of the base where it has none) that a seed draws, by their chances in thousandths."""

    def of(rules: tuple[M.Rule, ...]) -> Column:
        draw = lambda nth: F.conv(F.substring(F.md5(F.concat(seed, F.lit(f"|{nth}|chance")).cast("binary")), 1, 12), 16, 10).cast("long") % 1000
        return F.array_compact(F.array(*(F.when(draw(nth) < rule.chance * boost, F.lit(nth)) for nth, rule in enumerate(rules))))

    chosen = of(M.BASE)
    for name, rules in M.FAMILIES.items():
        chosen = F.when(language == name, of(rules)).otherwise(chosen)
    return chosen


def mutated(rows: DataFrame, content: str = "content", seed: str = "seed", language: str = "type", boost: int = 1) -> DataFrame:
    """rows with two more columns: rules, the numbers of the rules drawn for the seed, and mutated, the content after them.

    Each rule that is drawn changes one drawn match. Rows that draw none, nearly all, stay where they are; the others are
    rewritten in a pass bounded by bytes. A null content stays null.
    """
    drawn = rows.withColumn("rules", rules_drawn(F.col(seed), F.col(language), boost))
    change = X.Scan(lambda text, key, name: M.mutate(text, key, name or "", boost), "string", pa.string())
    idle = drawn.filter(F.size("rules") == 0).withColumn("mutated", F.col(content))
    return idle.unionByName(X.scanned(drawn.filter(F.size("rules") > 0), mutated=(change, content, seed, language)))
