"""Small column helpers shared by the operators of this package.

Working columns start with ``__v_``; an input column of that form is not
supported. A result column replaces an input column of the same name, whatever
its case, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop every column whose lower-cased name is among ``names``."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (start, stop, match), in code points.

    The pieces between the matches and the matches themselves alternate, so
    running sums of their lengths are the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")

    def walk(pieces: Column, hits: Column) -> Column:
        starts = F.aggregate(
            F.sequence(F.lit(0), F.size(hits) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, i: let(
                s["at"] + F.length(F.get(pieces, i)),
                lambda a: F.struct((a + F.length(F.get(hits, i))).alias("at"), F.concat(s["out"], F.array(a)).alias("out")),
            ),
            lambda s: s["out"],
        )
        return let(
            starts,
            lambda e: F.transform(
                hits,
                lambda m, i: F.struct(
                    F.get(e, i).alias("start"), (F.get(e, i) + F.length(m)).alias("stop"), m.alias("match")
                ),
            ),
        )

    return let(
        found,
        lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda p: walk(p, hits))).otherwise(empty),
    )
