"""One seed's continuation put into another's state, for pairs of seeds and both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as X
from ..functions.text import lines

#: What opens and closes PHP code, which a continuation within PHP code must not have.
PHP_OPEN, PHP_CLOSE = r"^\s*<\?php\b", r"\?>\s*\z"


def unwrapped(content: Column, language: str) -> Column:
    """The content without the tags that its language puts around code, once each."""
    return F.regexp_replace(F.regexp_replace(content, PHP_OPEN, ""), PHP_CLOSE, "") if X.language_of(language) == "php" else content


def splice_points(seeds: DataFrame, language: str, seed: int, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, body, host, category, indent, begin, until) of every seed: where another one's lines can go, and which of its own can go to another.

    Lines go behind the host's point, a line with the most live variables, else behind the last line. What goes to another
    begins behind the donor's point, drawn on its own, or with the first line, and ends before it would close a bracket
    that it did not open.
    """
    bodies = seeds.select(F.col(id_col).alias("id"), unwrapped(F.col(content), language).alias("body"), F.lit(language).alias("language"))
    placed = X.scanned(bodies, points=("complex_states", "body", "language"))
    host, donor = (X.pick_point(F.col("points"), s, F.col("id")) for s in (seed, seed + 1))
    drawn = placed.select("id", "body", "language", host.alias("h"), F.coalesce(donor["line_idx"] + 1, F.lit(0)).alias("begin"))
    ended = X.scanned(drawn, until=("balanced_end", "body", "language", "begin"))
    last = F.greatest(F.size(lines(F.col("body"))) - 1, F.lit(0))
    return ended.select("id", "body", F.coalesce("h.line_idx", last).alias("host"), F.coalesce("h.category", F.lit("fallback")).alias("category"), F.coalesce("h.indent", F.lit("")).alias("indent"), "begin", "until")


def grafts(pairs: DataFrame, points: DataFrame, tag: str | None = None) -> DataFrame:
    """(id_lo, id_hi, direction, category, grafted) of pairs (id_lo, id_hi): ab puts the second seed's lines into the first, ba the other way.

    points: splice_points() of the seeds, which are scanned once, however many pairs they are in. A pair with a seed that
    is not there or has no content gives nothing.
    """
    a, b = (points.filter("body IS NOT NULL").select(*(F.col(c).alias(f"{side}_{c}") for c in points.columns)) for side in ("host", "donor"))
    both = pairs.select("id_lo", "id_hi", F.explode(F.array(F.struct(F.lit("ab").alias("direction"), F.col("id_lo").alias("h"), F.col("id_hi").alias("d")), F.struct(F.lit("ba").alias("direction"), F.col("id_hi").alias("h"), F.col("id_lo").alias("d")))).alias("x")).select("id_lo", "id_hi", "x.*")
    met = both.join(a, F.col("h") == F.col("host_id")).join(b, F.col("d") == F.col("donor_id"))
    given = F.array_join(F.slice(lines(F.col("donor_body")), F.lit(1), F.coalesce("donor_until", F.lit(0))), "\n")
    put = X.graft(F.col("host_body"), given, F.col("host_host"), F.col("host_indent"), F.col("donor_begin") - 1, F.lit(tag).cast("string"))
    return met.select("id_lo", "id_hi", "direction", F.col("host_category").alias("category"), put.alias("grafted"))
