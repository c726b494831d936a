"""Personal data by recognisers: patterns, checks of digits, context, and one finding a place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import empty_if_null
from .safety import PERSONAL, findings

#: Characters on either side in which a context word counts, and what it adds to a score.
AROUND, CONTEXT = 40, 0.35
#: Findings below this score are left out.
LEAST = 0.4


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits end in the check digit of payment cards."""
    each = F.transform(F.split(F.reverse(digits(text)), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def iban(text: Column) -> Column:
    """Whether the remainder by 97 is 1 when the first four characters are put last and letters count from 10."""
    bare = F.upper(F.regexp_replace(text, "[ -]", ""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.cast("int"))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: (r * F.when(c.between("A", "Z"), 100).otherwise(10) + value(c)) % 97) == 1


def social(text: Column) -> Column:
    """Numbers that may have been given out: no part of zeros, none that begins with 666 or 9."""
    return ~text.rlike(r"^(000|666|9)|-00-|-0000$")


def octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda n: n.cast("int") <= 255)


@dataclass
class Recogniser:
    """A category's pattern, its score, what a match must pass (or it's left out) or is raised to by passing, and words that make it likelier nearby."""

    pattern: str
    score: float
    check: Callable[[Column], Column] | None = None
    raised: float | None = None
    context: list[str] = field(default_factory=list)


RECOGNISERS = {
    "EMAIL": Recogniser(PERSONAL["EMAIL"], 1.0),
    # Not inside a longer number or code.
    "PHONE": Recogniser(r"(?<![\w+])" + PERSONAL["PHONE"] + r"(?!\w)", 0.4, context=["phone", "call", "tel", "mobile", "fax"]),
    "SSN": Recogniser(PERSONAL["SSN"], 0.5, social, context=["ssn", "social security"]),
    "CREDIT_CARD": Recogniser(PERSONAL["CREDIT_CARD"], 0.3, luhn, 0.9, context=["card", "visa", "credit"]),
    "IBAN": Recogniser(r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b", 0.3, iban, 1.0, context=["iban", "account"]),
    "IP_ADDRESS": Recogniser(PERSONAL["IP_ADDRESS"], 0.6, octets, context=["ip", "address", "host"]),
}

FINDING = ["start", "end", "category", "score", "text"]


def choose(starts: list[int], ends: list[int], scores: list[float]) -> list[int]:
    """Places of spans that don't overlap with the largest sum of scores; of equal sums the longer cover, then the earlier spans. Spans are in the order of ends."""
    n = len(starts)
    best: list[tuple[float, int, tuple]] = [(0.0, 0, ())]
    chosen: list[list[int]] = [[]]
    for i in range(n):
        free = max((j for j in range(i + 1) if j == 0 or ends[j - 1] <= starts[i]), default=0)
        take = (round(best[free][0] + scores[i], 9), best[free][1] + ends[i] - starts[i], (*best[free][2], -starts[i]))
        if take > best[i]:
            best.append(take)
            chosen.append([*chosen[free], i])
        else:
            best.append(best[i])
            chosen.append(chosen[i])
    return chosen[n]


def _chosen(found: Column) -> Column:
    """The winners of overlapping findings. Runs that don't touch are weighed apart, so that a text's many findings cost no more than its overlaps do."""

    def run(starts: pd.Series, ends: pd.Series, scores: pd.Series) -> pd.Series:
        out = []
        for s, e, v in zip(starts, ends, scores):
            s, e, v = list(map(int, s)), list(map(int, e)), list(map(float, v))
            order = sorted(range(len(s)), key=lambda i: (s[i], e[i]))
            kept, group, reach = [], [], -1
            for i in [*order, None]:
                if i is None or (group and s[i] >= reach):
                    group.sort(key=lambda j: (e[j], s[j], j))
                    kept += [group[p] for p in choose([s[j] for j in group], [e[j] for j in group], [v[j] for j in group])]
                    group, reach = [], -1
                if i is not None:
                    group.append(i)
                    reach = max(reach, e[i])
            out.append(sorted(kept, key=lambda j: s[j]))
        return pd.Series(out)

    run.__annotations__ = {"starts": pd.Series, "ends": pd.Series, "scores": pd.Series, "return": pd.Series}
    # As if not deterministic, so that the call isn't copied into expressions that can't hold it.
    return F.pandas_udf(run, ArrayType(IntegerType())).asNondeterministic()(found["start"], found["end"], found["score"])


def recognised(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", recognisers: dict[str, Recogniser] | None = None, least: float = LEAST) -> DataFrame:
    """rows with findings: an array of FINDING in the order of their places, offsets in characters from 0, none overlapping.

    A match that fails its check is left out unless passing raises its score; context words nearby add CONTEXT, up to 1. Of overlapping findings those stay
    whose scores add up to most. Each row has its findings, also where ids repeat or are null; a null or empty text has none. What is
    gathered is one text's findings.
    """
    recognisers = RECOGNISERS if recognisers is None else recognisers
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    text = F.regexp_replace(empty_if_null(F.col(text_col)), "\x1e", " ")
    found = None
    for category, r in recognisers.items():
        # Where a pattern's letter or digit is missing, nothing is searched.
        each = findings(numbered.select("_row", text.alias("_text")), "_row", "_text", {category: r.pattern}, r.score)
        if r.check is not None:
            passed = F.coalesce(r.check(F.col("text")), F.lit(False))
            each = each.where(passed) if r.raised is None else each.withColumn("score", F.when(passed, F.lit(r.raised)).otherwise(F.col("score")))
        each = each.withColumn("context", F.array(*map(F.lit, r.context)).cast("array<string>"))
        found = each if found is None else found.unionByName(each)
    listed = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(*FINDING, "context"))).alias("_found"))
    both = numbered.join(listed, "_row", "left").withColumn("_body", text)
    near = lambda f: F.lower(F.concat_ws(" ", F.substring(F.col("_body"), F.greatest(f["start"] - AROUND, F.lit(0)) + 1, F.least(f["start"], F.lit(AROUND))), F.substring(F.col("_body"), f["end"] + 1, F.lit(AROUND))))
    likelier = lambda f: F.exists(f["context"], lambda w: F.contains(near(f), w))
    score = lambda f: F.when(likelier(f), F.least(F.round(f["score"] + CONTEXT, 6), F.lit(1.0))).otherwise(f["score"])
    made = F.transform(F.coalesce("_found", F.array().cast(listed.schema["_found"].dataType)), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["category"].alias("category"), score(f).alias("score"), f["text"].alias("text")))
    both = both.withColumn("findings", F.filter(made, lambda f: f["score"] >= least))
    both = both.withColumn("_kept", F.when(F.size("findings") > 1, _chosen(F.col("findings"))))
    kept = F.when(F.col("_kept").isNull(), F.col("findings")).otherwise(F.transform("_kept", lambda i: F.get(F.col("findings"), i)))
    return both.select(*rows.columns, kept.alias("findings"))


def spliced(text: Column, found: Column, mask: str | None = "[REDACTED]") -> Column:
    """The text with each finding masked, or each replaced by its category in brackets where mask is None; from the right to the left, so that offsets stay true."""
    put = (lambda f: F.lit(mask)) if mask is not None else (lambda f: F.concat(F.lit("["), f["category"], F.lit("]")))
    return F.aggregate(F.reverse(found), empty_if_null(text), lambda t, f: F.concat(F.substring(t, F.lit(1), f["start"]), put(f), F.substring(t, f["end"] + 1, F.length(t))))
