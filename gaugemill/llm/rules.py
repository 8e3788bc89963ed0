"""Quality rules as a ledger of failure bits, under versioned policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import set_aside
from gaugemill.llm.textstats import MEASURES, measure

#: The rules in bit order. Each is a condition on the measurements that holds for a bad text.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "100 * n_upper > 30 * word_chars",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "many_marks": "100 * n_marks > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the decision: the rules that it enforces."""

    version: str
    enforced: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(name) for name in self.enforced)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("strict", tuple(RULES))
POLICIES = {p.version: p for p in (BASE, STRICT)}


def failure_bits() -> Column:
    """One bit per failed rule."""
    bits = F.lit(0).cast("long")
    for at, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << at)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, keep: list[str], text_col: str = "text", bits_as: str = "failed_bits") -> DataFrame:
    """The columns ``keep``, every measurement, and the bits of failed rules, one row per row of ``docs``.

    Rules are evaluated once here; policies and ablations read bits only. Null and empty texts fail ``few_words``
    and nothing that divides by their size. Repeated rows stay repeated. Names in ``keep`` must not be measurements.
    """
    return measure(docs, keep, text_col).withColumn(bits_as, failure_bits())


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    """Whether no rule that ``policy`` enforces failed."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def passing(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged, whatever these are called."""
    own, back = set_aside(docs, [*MEASURES, "failed_bits"])
    text = next((new for new, old in back.items() if old == text_col), text_col)
    # the text itself is measured under a name of its own, so that it can also be kept
    entries = ledger(own.withColumn("__gm_text", F.col(text)), own.columns, "__gm_text")
    return entries.where(passes(policy)).select(*own.columns).withColumnsRenamed(back)


def ablations(entries: DataFrame, policy: Policy, bits: str = "failed_bits") -> DataFrame:
    """For each enforced rule: rows that fail it, and rows that only this rule rejects.

    Rows are first counted by bit pattern, of which there are at most two to the number of rules, in map tasks.
    """
    patterns = entries.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask)).alias("pattern")).agg(F.count("*").alias("n"))
    rule = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << list(RULES).index(n)).cast("long").alias("bit"))
                     for n in policy.enforced])
    return (
        patterns.select("pattern", "n", F.explode(rule).alias("r")).groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("pattern").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("pattern") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        )
        .withColumn("policy", F.lit(policy.version))
    )
