"""eIds of provisions as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def section(number: Column) -> Column:
    return F.concat(F.lit("sec_"), F.lower(number))


def below(parent: Column, level: str, number: Column) -> Column:
    """A child's eId; level is subsec, cl, subcl, subrule, item or proviso."""
    return F.concat(parent, F.lit(f"__{level}_"), F.lower(number.cast("string")))


def explanation(parent: Column, number: Column | None = None) -> Column:
    """Unnumbered explanations have no number the first time."""
    if number is None:
        return F.concat(parent, F.lit("__expl"))
    return F.concat(parent, F.lit("__expl_"), number.cast("string"))


def schedule(ordinal: Column) -> Column:
    return F.concat(F.lit("schedule_"), ordinal.cast("string"))


def rule(number: Column, subrule: Column | None = None) -> Column:
    base = F.concat(F.lit("rule_"), F.lower(number))
    return base if subrule is None else F.when(subrule.isNull(), base).otherwise(below(base, "subrule", subrule))


def provision(section_number: Column, subsection: Column, clause: Column, subclause: Column) -> Column:
    """A locator path's eId; levels that are null are left out."""
    part = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name), F.lower(c)))
    return F.concat_ws("__", section(section_number), part("subsec_", subsection), part("cl_", clause), part("subcl_", subclause))


def deduplicated(base: Column, order: list[str], keys: tuple[str, ...] = ("doc_id",)) -> Column:
    """The base, or the base with its count from the second time on."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys, base).orderBy(*order))
    return F.when(n == 1, base).otherwise(F.concat(base, F.lit("__dup"), n.cast("string")))


def expected_clause_label(ordinal: Column) -> Column:
    """a to z, then aa, ab and so on."""
    rest = ordinal - 26
    return F.when(ordinal < 26, F.char(97 + ordinal)).otherwise(F.concat(F.char(97 + F.floor(rest / 26)), F.char(97 + rest % 26)))
