"""Exact quantiles of huge columns by narrowing brackets.

Sorting or grouping a whole column of distinct values shuffles all of it. Instead every wanted rank gets a bracket:
an open interval between two values. A sketch of the values inside proposes two closer ones, and a count over all
rows tells whether the rank is that of one of them, lies between them, or outside (then the bracket stays as wide on
that side). Ties at an end are counted apart, so they cannot keep a bracket wide. What is left of a bracket is
counted value by value. The path is the same for every size, and the result never depends on the sketch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEW_ROWS = 100_000  # a bracket this small is counted value by value, in one task
ACCURACY = 5_000  # of the sketch: ranks are off by one in so many at most


@dataclass(frozen=True)
class _Bracket:
    """Values between ``low`` and ``high``, neither included; ``below`` rows are at or under ``low``."""

    feature: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    margin: float = 2.0
    value: float | None = None

    def holds(self) -> str:
        """SQL condition. Texts keep the many bracket expressions cheap to build."""
        sides = [f"`{self.feature}` IS NOT NULL"]
        if self.low is not None:
            sides.append(f"`{self.feature}` > double('{self.low!r}')")
        if self.high is not None:
            sides.append(f"`{self.feature}` < double('{self.high!r}')")
        return "(" + " AND ".join(sides) + ")"


def _proposed(rows: DataFrame, brackets: Sequence[_Bracket]) -> list[tuple[float | None, float | None]]:
    """Two values around each wanted rank, from one sketch for all brackets with equal bounds."""
    shared: dict[str, list[int]] = {}
    for i, b in enumerate(brackets):
        shared.setdefault(b.holds(), []).append(i)
    calls = []
    for holds, group in shared.items():
        wanted = []
        for b in (brackets[i] for i in group):
            at = (b.rank - b.below + 0.5) / b.inside
            wanted += [max(0.0, at - b.margin / ACCURACY), min(1.0, at + b.margin / ACCURACY)]
        listed = ", ".join(f"double('{w!r}')" for w in wanted)
        feature = brackets[group[0]].feature
        calls.append(f"percentile_approx(CASE WHEN {holds} THEN `{feature}` END, array({listed}), {ACCURACY})")
    found = rows.selectExpr(*calls).first()
    out: list[tuple[float | None, float | None]] = [(None, None)] * len(brackets)
    for values, group in zip(found, shared.values()):
        for j, i in enumerate(group):
            out[i] = (values[2 * j], values[2 * j + 1])
    return out


def _narrowed(rows: DataFrame, brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """One round: the brackets closer around their ranks, or with their value found."""
    ends = _proposed(rows, brackets)
    texts: dict[str, int] = {}
    for b, pair in zip(brackets, ends):
        for end in pair:
            for sign in ("<", "<="):
                texts.setdefault(f"count_if(`{b.feature}` {sign} double('{end!r}'))", len(texts))
    counts = rows.selectExpr(*texts).first()

    def count(b: _Bracket, sign: str, end: float) -> int:
        return counts[texts[f"count_if(`{b.feature}` {sign} double('{end!r}'))"]]

    out = []
    for b, (low, high) in zip(brackets, ends):
        after = b
        for end in (low, high):
            under, upto = count(b, "<", end), count(b, "<=", end)
            if under <= b.rank < upto:
                after = replace(after, value=end)
            elif upto <= b.rank and (after.low is None or end > after.low):
                after = replace(after, low=end, inside=after.inside - (upto - after.below), below=upto)
            elif under > b.rank and (after.high is None or end < after.high):
                after = replace(after, high=end, inside=under - after.below)
        halved = after.inside <= b.inside / 2
        out.append(after if halved else replace(after, margin=b.margin * 4))
    return out


def values_at_ranks(
    rows: DataFrame, ranks: Mapping[str, Sequence[tuple[int, int]]], sizes: Mapping[str, int], few: int = FEW_ROWS
) -> dict[str, list[tuple[float, float]]]:
    """For each feature column and each (low, high) pair of 0-based ranks, the values there.

    The result holds two numbers per wanted rank pair, which is all the driver receives.
    """
    wanted = list(dict.fromkeys((f, rank) for f, pairs in ranks.items() for pair in pairs for rank in pair))
    if not wanted:
        return {}
    brackets = [_Bracket(f, rank, sizes[f]) for f, rank in wanted]
    while wide := [b for b in brackets if b.value is None and (b.inside > few or b.low is None and b.high is None)]:
        done = [b for b in brackets if b not in wide]
        brackets = done + _narrowed(rows, wide)
    known = {(b.feature, b.rank): b.value for b in brackets if b.value is not None}
    open_ = [b for b in brackets if b.value is None]
    if open_:
        spans = {b.holds(): b for b in open_}
        cells = ", ".join(
            f"struct({i} AS span, CASE WHEN {holds} THEN `{b.feature}` END AS value)" for i, (holds, b) in enumerate(spans.items())
        )
        counts = (
            rows.where(" OR ".join(spans)).selectExpr(f"inline(array({cells}))").where("value IS NOT NULL")
            .groupBy("span", "value").agg(F.count("*").alias("n"))
        )
        number = {holds: i for i, holds in enumerate(spans)}
        asked = rows.sparkSession.range(1).selectExpr("inline(array(" + ", ".join(
            f"struct({number[b.holds()]} AS span, '{b.feature}' AS feature, {b.rank}L AS rank, {b.rank - b.below}L AS place)"
            for b in open_) + "))")
        upto = F.sum("n").over(Window.partitionBy("span").orderBy("value"))  # at most ``few`` rows a span
        found = (
            counts.withColumn("upto", upto).join(F.broadcast(asked), "span")  # a row per wanted rank
            .where("upto > place AND upto - n <= place").select("feature", "rank", "value").collect()
        )
        known |= {(r["feature"], r["rank"]): r["value"] for r in found}
    return {f: [(known[f, low], known[f, high]) for low, high in pairs] for f, pairs in ranks.items()}
