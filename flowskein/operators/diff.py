"""Field-by-field differences between two copies of a data set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A compared field; ``tolerance`` makes numbers equal that are no farther apart."""

    name: str
    tolerance: float | None = None

    def differs(self) -> str:
        """SQL that is true where the field of ``__l`` and ``__r`` differs; never null.

        Null equals only null, NaN only NaN, an infinity only itself.
        """
        a, b = f"__l.`{self.name}`", f"__r.`{self.name}`"
        if self.tolerance is None:
            return f"NOT ({a} <=> {b})"
        # abs() of two equal infinities is NaN, hence the equality first
        return f"NOT ({a} <=> {b}) AND coalesce(isnan({a}) OR isnan({b}) OR abs({a} - {b}) > {self.tolerance!r}D, true)"


def number_text(value: Column) -> Column:
    """A number spelled as text: blank is null, what is no number is NaN."""
    text = F.btrim(value, F.lit(" \t\r\n"))
    return F.when(text != "", F.coalesce(text.try_cast("double"), F.lit(float("nan"))))


def normal_key(value: Column) -> Column:
    return F.lower(F.btrim(value, F.lit(" \t\r\n")))


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], fields: list[Field]) -> DataFrame:
    """One row for each key with the structs ``__l`` and ``__r``, null where a side has none.

    Both inputs have the keys and fields under equal names and types; other
    columns are ignored. The sides are tagged, united and grouped once. Repeated
    rows collapse on the map side; if a side holds different rows for one key,
    the greatest struct in field order stands for it, and ``__l_low`` or
    ``__r_low``, the least, is not equal to it. Null keys group together.
    """
    names = [f.name for f in fields]

    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(*keys, F.struct(*names).alias("__v"), F.lit(side).alias("__side"))

    both = tagged(left, 0).unionByName(tagged(right, 1))
    own = lambda side: F.when(F.col("__side") == side, F.col("__v"))
    return both.groupBy(*keys).agg(F.max(own(0)).alias("__l"), F.max(own(1)).alias("__r"), F.min(own(0)).alias("__l_low"), F.min(own(1)).alias("__r_low"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[Field], left_name: str, right_name: str) -> DataFrame:
    """One row for each key and difference: ``only_<side>`` or the field's name in ``diff``.

    ``left_value`` and ``right_value`` hold the field's values as text. Empty
    inputs are allowed on either side.
    """
    listed = ", ".join(
        f"named_struct('diff', '{f.name}', 'is', {f.differs()}, 'l', cast(__l.`{f.name}` as string), 'r', cast(__r.`{f.name}` as string))"
        for f in fields
    )
    none = "cast(null as string)"
    found = f"""CASE
        WHEN __r IS NULL THEN array(named_struct('diff', 'only_{left_name}', 'is', true, 'l', {none}, 'r', {none}))
        WHEN __l IS NULL THEN array(named_struct('diff', 'only_{right_name}', 'is', true, 'l', {none}, 'r', {none}))
        ELSE filter(array({listed}), x -> x.is) END"""
    return (
        side_by_side(left, right, keys, fields)
        .select(*keys, F.explode(F.expr(found)).alias("__d"))
        .select(*keys, "__d.diff", F.col("__d.l").alias("left_value"), F.col("__d.r").alias("right_value"))
    )


def conflicts(left: DataFrame, right: DataFrame, keys: list[str], fields: list[Field], left_name: str, right_name: str) -> DataFrame:
    """Keys of which one copy holds different rows within itself: ``side`` and the first ``field`` that is not the same in all of them.

    Told by the least and the greatest row of the side in field order, so the
    field is the first that differs between any two; fields compare exactly
    after their tolerance.
    """
    rows = side_by_side(left, right, keys, fields)
    parts = []
    for side, name in (("l", left_name), ("r", right_name)):
        one = rows.select(*keys, F.col(f"__{side}").alias("__l"), F.col(f"__{side}_low").alias("__r")).filter("__l IS NOT NULL")
        first = F.coalesce(*(F.when(F.expr(f.differs()), F.lit(f.name)) for f in fields))
        parts.append(one.select(*keys, F.lit(name).alias("side"), first.alias("field")).filter("field IS NOT NULL"))
    return parts[0].unionByName(parts[1])
