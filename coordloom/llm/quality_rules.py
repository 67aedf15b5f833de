"""Quality rules as a ledger: every rule once, failures as bits, policies over the bits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordloom.llm.text_stats import BASE, MORE, with_measures


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements under which a text fails."""

    name: str
    fails: str


#: A rule's place in this list is its bit for good: append, never reorder or reuse.
RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", "n_upper > n_lower AND n_upper >= 20"),
    Rule("stammering", "5 * n_same_next > n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
]

#: Policies by version: the rules that reject a text.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols"],
    "v2": [r.name for r in RULES],
}


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules."""
    bits = {r.name: 1 << k for k, r in enumerate(rules)}
    unknown = [n for n in names if n not in bits]
    if unknown:
        raise ValueError(f"no such rules: {unknown}")
    return sum(bits[n] for n in set(names))


def ledger(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with its measurements and ``failures``, the bits of the rules it fails.

    One pass, no shuffle. Null and empty texts measure zero and fail ``few_words``;
    repeated rows stay; columns with the names of measurements are replaced.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    failures = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        failed = F.coalesce(F.expr(rule.fails), F.lit(False))
        failures = failures.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(0).cast("long"))
    return with_measures(df.drop("failures"), text, more=True).withColumn("failures", failures)


def rejected(policy: Sequence[str], failures: str = "failures") -> Column:
    """Whether a policy rejects a row of the ledger."""
    return F.col(failures).bitwiseAND(F.lit(mask_of(policy))) != 0


def kept(df: DataFrame, policy: Sequence[str], text: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the columns of ``df`` as they were."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"),
                       F.col(f"`{text}`").alias("text"))
    return ledger(packed).filter(~rejected(policy)).select("own.*")


def ablations(ledger_df: DataFrame, policy: Sequence[str],
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: rows failing it, rows only it rejects, and rows that
    the policy without it rejects.

    The ledger is first counted by its bits under the policy, at most two to the number
    of rules, so that the shuffle holds counts and not rows. An empty ledger gives zeros.
    """
    mask = mask_of(policy, rules)
    counts = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count("*").alias("n"))
    sums = []
    for name in policy:
        bit = mask_of([name], rules)
        for kind, condition in (
            ("fail", F.col("bits").bitwiseAND(F.lit(bit)) != 0),
            ("only", F.col("bits") == bit),
            ("rest", F.col("bits").bitwiseAND(F.lit(mask & ~bit)) != 0),
        ):
            sums.append(F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
                        .cast("long").alias(f"{kind}_{name}"))
    row = counts.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(
        F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("n_failing"),
        F.col(f"only_{n}").alias("n_only_this"), F.col(f"rest_{n}").alias("n_without"),
    ) for n in policy))).alias("r")).select("r.*")


def verdicts(df: DataFrame, policy: Sequence[str] = POLICIES["v2"], text: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; other measurements are dropped."""
    found = ledger(df, text)
    return found.withColumns({
        "base_failed": rejected(POLICIES["base"]),
        "kept": ~rejected(POLICIES["base"]) & ~rejected(policy),
    }).drop(*[c for c in MORE if c not in BASE])
