"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and a
bit mask with one bit for each failed rule; a policy is a version, a mask of the rules that
it enforces and the number of them that may fail. Policies and their ablations are applied
to the ledger alone, by bitwise operations: no text is read again.

Words are runs of anything but the six ASCII white space characters; a line is a part
between line feeds. A null text has no words, an empty text neither; both fail `too_short`.
Rows are independent: repeated rows and null ids give one ledger row each.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import map_rows

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_upper",
)
_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    total, end = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        dup,
        _repeat_words(words),
        lines,
        sum(map(str.isalpha, text)),
        sum(map(str.isupper, text)),
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where `failed` holds; bit is its place in the mask and never reused."""

    name: str
    bit: int
    failed: Column


def rules() -> list[Rule]:
    """The rule book. Bits 0 and 1 are the base rules."""
    c = F.col
    return [
        Rule("too_short", 0, c("n_words") < 50),
        Rule("repeated_windows", 1, 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("symbols", 2, 100 * c("n_symbols") > 25 * c("n_words")),
        Rule("duplicate_lines", 3, 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule("shouting", 4, (c("n_letters") > 0) & (100 * c("n_upper") > 50 * c("n_letters"))),
        Rule("long_words", 5, c("word_chars") > 40 * c("n_words")),
    ]


BASE_MASK = 0b11
#: version -> (mask of enforced rules, enforced rules that may fail)
POLICIES = {"base": (BASE_MASK, 0), "v1": (0b111111, 0), "lenient": (0b111111, 1)}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row for each row of docs (doc_id, text)."""
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    out = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), lambda: lambda i, t: (i, *measure(t)), schema)
    bits = F.lit(0).cast("long")
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.failed, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("fail_bits", bits)


def verdict(version: str, bits: str | Column = "fail_bits") -> Column:
    """Whether a policy keeps a row of the ledger."""
    mask, allowed = POLICIES[version]
    hit = (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(mask).cast("long"))
    return (hit == 0) if not allowed else (F.bit_count(hit) <= allowed)


def ablation(book: DataFrame, version: str) -> DataFrame:
    """rule, n_failed, n_only (dropped by this rule alone), n_kept_without: one row for each enforced rule.

    The ledger is first counted by failure pattern (at most 2 ** rules rows), so the texts and
    the documents are not touched again. An empty ledger gives zeros.
    """
    mask, allowed = POLICIES[version]
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    aggs = []
    for r in (r for r in rules() if mask >> r.bit & 1):
        own = F.lit(1 << r.bit).cast("long")
        has = F.col("pattern").bitwiseAND(own) != 0
        rest = F.bit_count(F.col("pattern").bitwiseAND(F.lit(mask & ~(1 << r.bit)).cast("long"))) <= allowed
        total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        dropped = F.bit_count("pattern") > allowed
        aggs.append(F.struct(F.lit(r.name).alias("rule"), total(has).alias("n_failed"), total(has & dropped & rest).alias("n_only"), total(rest).alias("n_kept_without")))
    return patterns.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def profile(book: DataFrame, *keys: str) -> DataFrame:
    """Failure bits of groups: rules that any, and that every, document of a group fails."""
    return book.groupBy(*keys).agg(F.bit_or("fail_bits").alias("any_bits"), F.bit_and("fail_bits").alias("all_bits"), F.count(F.lit(1)).alias("n"))


def report(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy; kept is false if a base rule failed."""
    book = ledger(docs)
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0
    return book.withColumns({"base_failed": failed, "kept": ~failed & verdict(version)})
