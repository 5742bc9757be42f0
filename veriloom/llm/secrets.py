"""Secret scans: fixed patterns plus sliding-window entropy.

Base kinds are leftmost, non-overlapping matches per kind: ``assign`` (a name
of a credential, ``:`` or ``=``, a value of eight or more characters),
``access`` (``AKIA`` keys of 16 or more) and ``hex`` (32 or more digits).

``entropy`` spans come from candidate strings of 20 or more characters. A
window of 20 slides over the candidate; the sum of ``c * log2(c)`` over the
counts of its characters is kept up to date from the one character that enters
and the one that leaves. Logarithms are a table of whole millionths, so sums
are exact and do not depend on the path. The limit belongs to the character
class of the candidate: hexadecimal, or letters with digits. Windows under the
limit that touch form one span. Candidates on the allow list and spans inside
a base span are dropped.

Everything is a function of one row; the plan is a scan and a projection.

Null text is empty. An empty text, or one without secrets, has empty spans.
Repeated rows are scanned alike. An empty table gives an empty result. Columns
named like a result are replaced. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, spans_of, text_of, without

# The credential names and the patterns of the base kinds.
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
VALUE = "[A-Za-z0-9+/_.=-]+"


def either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


ASSIGN = rf"""({'|'.join(map(either_case, NAMES))})["']?\x20*[:=]\x20*["']?({VALUE})"""
# The shortest accepted length is part of these two: a shorter run holds no longer one.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]
MIN_VALUE = 8

WINDOW = 20
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
UNIT = 1_000_000
#: c * log2(c) in millionths for c = 0 .. WINDOW
WEIGHT = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]
#: Least bits per character in a window, by class.
HEX_BITS, MIXED_BITS = 3.0, 3.7
# Parts of well-known samples and stand-ins, lower case.
ALLOWED = [
    "example", "sample", "placeholder", "changeme", "your_", "your-", "dummy", "xxxx", "abcdefgh", "0123456", "1234567",
    "00000000", "ffffffff", "deadbeef",
]
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
RESULT = ["spans", "redacted"]


def limit(bits: float) -> int:
    """Largest sum of c * log2(c) of a window with at least ``bits`` per character."""
    return round((WINDOW * math.log2(WINDOW) - WINDOW * bits) * UNIT)


def allowed(candidate: Column) -> Column:
    low = F.lower(candidate)
    out = candidate.rlike(UUID)
    for part in ALLOWED:
        out = out | F.contains(low, F.lit(part))
    return out


def surprising_runs(candidate: Column) -> Column:
    """Runs of touching windows under the limit as (start, stop) inside the candidate."""
    weights = F.array(*[F.lit(w) for w in WEIGHT])
    bound = F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(limit(HEX_BITS))).otherwise(F.lit(limit(MIXED_BITS)))

    def slide(codes: Column, table: Column, most: Column) -> Column:
        first = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).alias("sum"),
            F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"),
        )

        def step(s: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))

            def moved(s1: Column) -> Column:
                window = i - (WINDOW - 1)
                good = (window >= 0) & (s1["sum"] <= most)
                joins = good & (s["start"] >= 0) & (window <= s["stop"])
                closes = good & (s["start"] >= 0) & (window > s["stop"])
                return F.struct(
                    s1["counts"].alias("counts"),
                    s1["sum"].alias("sum"),
                    F.when(good & ~joins, window).otherwise(s["start"]).alias("start"),
                    F.when(good, i + 1).otherwise(s["stop"]).alias("stop"),
                    F.when(closes, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))
                    .otherwise(s["out"])
                    .alias("out"),
                )

            def taken(n: Column) -> Column:
                """One fewer of the character that leaves, one more of the one that enters."""
                same = enters == leaves
                gain = F.when(same, 0).otherwise(F.get(table, F.get(n, enters) + 1) - F.get(table, F.get(n, enters)))
                loss = F.when(same | (leaves < 0), 0).otherwise(
                    F.get(table, F.get(n, leaves)) - F.get(table, F.get(n, leaves) - 1)
                )
                counts = F.transform(
                    n, lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0)
                )
                return F.struct(counts.alias("counts"), (s["sum"] + gain - loss).alias("sum"))

            return let(taken(s["counts"]), moved)

        last = lambda s: F.when(
            s["start"] >= 0, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
        ).otherwise(s["out"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), first, step, last)

    # Cut once: reading each character by its position would walk from the start every time.
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    return F.when(
        mixed & ~allowed(candidate), let(codes, lambda c: let(weights, lambda t: let(bound, lambda b: slide(c, t, b))))
    ).otherwise(none)


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["stop"].alias("stop"), F.lit(kind).alias("kind")
        ),
    )


def base_spans(text: Column) -> Column:
    assign = F.filter(
        spans_of(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= MIN_VALUE
    )
    return F.concat(_typed(assign, "assign"), _typed(spans_of(text, ACCESS), "access"), _typed(spans_of(text, HEX), "hex"))


def entropy_spans(text: Column) -> Column:
    runs = F.flatten(
        F.transform(
            spans_of(text, CANDIDATE),
            lambda m: F.transform(
                surprising_runs(m["match"]),
                lambda r: F.struct((m["start"] + r["start"]).alias("start"), (m["start"] + r["stop"]).alias("stop")),
            ),
        )
    )
    return _typed(runs, "entropy")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every union of overlapping spans replaced by ``mark``."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda s, m: F.concat(F.substr(text, s["at"] + 1, m["start"] - s["at"]), F.lit(mark))
    return F.aggregate(
        spans,
        begin,
        lambda s, m: F.struct(
            F.greatest(s["at"], m["stop"]).alias("at"),
            F.when((m["start"] < s["at"]) & (s["at"] > 0), s["out"]).otherwise(F.concat(s["out"], F.array(piece(s, m)))).alias("out"),
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.length(text))),
    )


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, an array of (start, rank, stop, kind) in order, and the ``redacted`` text."""
    base = without(docs, RESULT)
    text = text_of(text_col)
    found = let(
        base_spans(text),
        lambda own: F.sort_array(
            F.concat(
                own,
                F.filter(
                    entropy_spans(text),
                    lambda e: ~F.exists(own, lambda b: (b["start"] <= e["start"]) & (e["stop"] <= b["stop"])),
                ),
            )
        ),
    )
    return base.select("*", found.alias("spans")).select("*", redacted(text, F.col("spans")).alias("redacted"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op4_secret_scan(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(digest(F.filter(spans, lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        digest(spans).alias("spans"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )
