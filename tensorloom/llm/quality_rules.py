"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document and leaves one failure bit and its
measurements in a ledger row. A policy is a versioned set of bits; verdicts under any
policy, and what each rule alone decides (ablation), follow from the stored bits by
bitwise operations and aggregates, without touching a text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, WORD, quoted

SYMBOLS = "#*$%&|<>"
#: Low bits of a packed window that hold its place in the text; the rest holds a hash.
PLACE_BITS = 28


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements

    def bit(self, k: int) -> Column:
        return F.when(F.expr(self.fails), F.lit(1 << k)).otherwise(F.lit(0))


RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)

#: Versioned policies: the rules that reject under each.
POLICIES = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbols", "word_length", "repeated_lines", "capitals"),
}
CURRENT = "v1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_capitals")


def policy_mask(names, rules=RULES) -> int:
    place = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << place[n] for n in set(names))


def _without(chars: str) -> Column:
    """Number of characters of the text that are among chars."""
    return (F.length("_text") - F.length(F.translate(F.col("_text"), chars, ""))).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id and the measurements of MEASURES for each row of docs; null text is empty.

    n_repeat_words: every 3-word window becomes one long, its hash above its place, so
    that sorting plain longs brings equal windows together. Neighbours with one hash are
    candidates; they alone are sorted again by their words, so a hash collision changes
    nothing. The windows found twice or more then cover min(3, step to the next) words.
    """
    held = [F.col(carry).alias("_carried")] if carry else []
    kept = ["_carried"] if carry else []
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *held)
    t = t.select(
        "doc_id",
        *kept,
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_w"),
        (F.length("_text") - F.length(F.translate(F.col("_text"), BLANKS, ""))).alias("_blank"),
        F.length("_text").alias("_len"),
        _without(SYMBOLS).alias("n_symbols"),
        _without(UPPER).alias("n_capitals"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    t = t.select("*", F.size("_w").cast("long").alias("n_words"))
    high = ~((1 << PLACE_BITS) - 1)
    t = t.withColumn(
        "_s",
        F.expr(
            f"sort_array(IF(n_words < 4, array(), transform(sequence(0, int(n_words) - 3), "
            f"i -> (xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) & {high}L) | i)))"
        ),
    )
    same = f"shiftright(x, {PLACE_BITS}) = shiftright(get(_s, k {{}} 1), {PLACE_BITS})"
    t = t.withColumn("_c", F.expr(f"transform(filter(_s, (x, k) -> {same.format('-')} OR {same.format('+')}), x -> int(x & {~high}L))"))
    t = t.withColumn("_g", F.expr("sort_array(transform(_c, i -> struct(concat_ws(' ', get(_w, i), get(_w, i + 1), get(_w, i + 2)) AS g, i AS i)))"))
    t = t.withColumn("_p", F.expr("sort_array(transform(filter(_g, (x, k) -> x.g = get(_g, k - 1).g OR x.g = get(_g, k + 1).g), x -> x.i))"))
    covered = "aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1), x + 3) - x)), 0L, (a, x) -> a + x)"
    row = F.struct(
        "doc_id",
        "n_words",
        (F.col("_len") - F.col("_blank")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.expr(covered).alias("n_repeat_words"),
        "n_capitals",
        *[F.col("_carried").alias(carry) for _ in kept],
    )
    # inline() keeps a later filter on a measurement from being pushed into these steps,
    # which would evaluate them again for every element
    return t.select(F.inline(F.array(row)))


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, carry: str | None = None) -> DataFrame:
    """One ledger row per row of docs: doc_id, the measurements and `failed` (bit k: rule k).

    Defined for all inputs: null and empty texts measure 0 and fail too_short; repeated
    rows are rated alike, each for itself; an empty table gives an empty ledger; no
    further column of docs is read, but for `carry`, which is passed through.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), [r.bit(k) for k, r in enumerate(rules)], F.lit(0))
    return measured(docs, id_col, text_col, carry).withColumn("failed", bits)


def apply_policy(ledger: DataFrame, policy: str = CURRENT, policies=POLICIES, rules=RULES) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version, from the bits alone."""

    def hit(names) -> Column:
        return F.col("failed").bitwiseAND(policy_mask(names, rules)) != 0

    return ledger.withColumns(
        {"base_failed": hit(policies["base"]), "kept": ~(hit(policies["base"]) | hit(policies[policy])), "policy": F.lit(policy)}
    )


def ablation(ledger: DataFrame, policy: str = CURRENT, policies=POLICIES, rules=RULES) -> DataFrame:
    """For every rule of a policy: rows that fail it, rows that only it rejects, rows kept without it.

    One aggregate over the stored bits; its result has a row for each rule.
    """
    mask, place = policy_mask(policies[policy], rules), {r.name: k for k, r in enumerate(rules)}
    failed = F.col("failed").bitwiseAND(mask)
    sums = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(failed.bitwiseAND(1 << place[name]) != 0).alias("n_failed"),
            F.count_if(failed == (1 << place[name])).alias("n_only"),
            F.count_if(failed.bitwiseAND(mask & ~(1 << place[name])) == 0).alias("n_kept_without"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for name in policies[policy]
    ]
    return ledger.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with their columns.

    A verdict belongs to the text alone, so it is computed in place, without a join.
    """
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("_row"))
    rated = rule_ledger(held, f"_row.{quoted(id_col)}", f"_row.{quoted(text_col)}", carry="_row")
    return apply_policy(rated, policy).filter("kept").select("_row.*")
