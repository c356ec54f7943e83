"""Quality rules: a learned decision list, with DataFrame functions only.

Text statistics are column expressions. From the statistics of a bounded sample of labelled documents, sequential
covering learns an ordered list of rules for the bad class: a rule grows by the threshold condition with the largest
information gain until it covers no good document, is pruned from its end on rows it did not grow on, and is kept if
it is precise there; the rows it covers are taken out and the next rule grows. The list is emitted as one ``CASE``
expression over the statistics, so that the verdict runs inside Spark and can be read.

The sample is bounded by ``max_labelled`` (the rows of least hash); it is what the driver learns from and what is
broadcast (16 bytes a row). Statistics and verdicts cover every document.

Defined cases: a null text has no words and all statistics 0; documents of too few or too repetitive words fail at the
base and aren't judged; without labels of both classes the list is empty and all that pass the base are kept; null or
repeated labels: null ones are ignored, repeated ones all count, also those that contradict each other; an extra column of any name stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, SPACE_CLASS, fresh, others, table

SYMBOLS = "[#*$%&|<>]"
#: The most values a text may repeat before its repeated windows are found by sorting rather than by look-up in a list.
FEW = 64
#: How many rows the driver learns from for each label of the sample at most (ids can repeat): those of least hash.
ROWS_A_LABEL = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once. Unlike columns on top of columns, this stays small when the optimizer
    moves a filter on the result below the projection."""
    return F.get(F.transform(F.array(value), body), 0)


def _triples(words: Column) -> Column:
    """A hash of each window of three words."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    return F.when(F.size(words) >= 3, F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeated_at(tri: Column, same: Column) -> Column:
    """The positions of the windows whose hash is one of same. If those are many, hashes are sorted with their positions
    and compared with their neighbours instead of looked up in a list."""
    listed = F.filter(F.sequence(F.lit(0), F.size(tri) - 1), lambda i: F.array_contains(same, F.get(tri, i)))

    def compared(order: Column) -> Column:
        alike = lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"])
        return F.transform(F.filter(order, alike), lambda x: x["i"])

    by_hash = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(same) <= FEW, listed).otherwise(_let(by_hash, compared))


def _covered(tri: Column) -> Column:
    """How many words stand in a window that is found twice."""
    doubles = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    at = _let(_let(F.sort_array(tri), doubles), lambda same: _repeated_at(tri, same))
    words = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(tri) == F.size(F.array_distinct(tri)), 0).otherwise(words)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns STATISTICS (long), in place of any of these names. n_repeat_words counts each word that
    stands in a window of three words found twice or more in the text."""
    t = F.coalesce(docs[text], F.lit(""))
    filled = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    by_words = _let(F.array_remove(F.split(t, SPACE_CLASS + "+", -1), ""), lambda w: F.struct(F.size(w).alias("n"), _let(_triples(w), _covered).alias("again")))
    helper = fresh(docs, "by_words")
    df = docs.select(
        *others(docs, *STATISTICS),
        by_words.alias(helper),
        _let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        (F.length(t) - F.regexp_count(t, F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        *[F.regexp_count(t, F.lit(what)).cast("long").alias(name) for name, what in (("n_symbols", SYMBOLS), ("n_upper", r"\p{Lu}"), ("n_digits", "[0-9]"), ("n_marks", "[!?]"))],
    )
    df = df.withColumns({"n_words": F.col(f"{helper}.n").cast("long"), "n_repeat_words": F.col(f"{helper}.again").cast("long")})
    return df.select(*others(df, *STATISTICS, helper), *STATISTICS)


#: What rules may test: each is a ratio, so that a threshold means the same for short and long texts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(rows: list[tuple[dict, bool]]) -> tuple[float, Condition | None]:
    """The threshold condition of the largest gain; thresholds lie midway between neighbouring values."""
    p0, best = sum(bad for _, bad in rows), (0.0, None)
    n0 = len(rows) - p0
    for f in FEATURES:
        order = sorted((row[f], bad) for row, bad in rows)
        p = n = 0
        for (x, bad), (following, _) in zip(order, order[1:], strict=False):
            p, n = p + bad, n + (not bad)
            if following > x:
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if (g := _gain(p0, n0, a, b)) > best[0]:
                        best = (g, Condition(f, above, (x + following) / 2))
    return best


def learn_rules(rows: list[tuple[dict[str, float], bool, int]], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_cover: int = 5) -> list[list[Condition]]:
    """rows: statistics, whether bad, and a number that deals them to growing (two of three) and pruning. Ends when max_rules
    are taken or fewer than min_cover bad rows are left to grow from."""
    grow, prune = [(r, y) for r, y, k in rows if k % 3], [(r, y) for r, y, k in rows if k % 3 == 0]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and sum(y for _, y in grow) >= min_cover:
        rule, left = [], grow
        while len(rule) < max_conditions and any(not y for _, y in left):
            gain, condition = _best_condition(left)
            if condition is None or gain <= 0:
                break
            rule, left = [*rule, condition], [(r, y) for r, y in left if condition.holds(r)]

        def worth(conditions: list[Condition], among: list[tuple[dict, bool]] = prune) -> tuple[float, int]:
            hit = [y for r, y in among if all(c.holds(r) for c in conditions)]
            return (2 * sum(hit) - len(hit)) / max(1, len(hit)), len(hit)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda c: worth(c)[0], default=[])
        covered = [y for r, y in [*grow, *prune] if all(c.holds(r) for c in rule)]
        if not rule:
            break
        if sum(covered) < min_cover or sum(covered) < min_precision * len(covered):
            # a weak rule isn't taken; the next ones grow from the bad rows that it doesn't hold for
            grow = [(r, y) for r, y in grow if not (y and all(c.holds(r) for c in rule))]
            continue
        rules.append(rule)
        grow = [(r, y) for r, y in grow if not all(c.holds(r) for c in rule)]
        prune = [(r, y) for r, y in prune if not all(c.holds(r) for c in rule)]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_labelled: int = 20_000) -> list[list[Condition]]:
    """Learns from at most max_labelled labelled rows whose document passes the base."""
    sample = F.broadcast(label_sample(labels, key, label, max_labelled))
    known = docs.select(docs[key].alias("known_key"), docs[text].alias("text")).join(sample, F.col("known_key") == F.col("label_key"))
    asked = [F.expr(e).alias(f) for f, e in FEATURES.items()]
    rows = text_statistics(known).select("known_key", *asked, "label_bad", "label_fold", base_failed().alias("failed")).where("NOT failed")
    # equal rows of an id count once, others all: documents that share an id, and labels that contradict each other
    rows = rows.distinct().withColumn("h", F.xxhash64(*rows.columns)).orderBy("h", *rows.columns).limit(ROWS_A_LABEL * max_labelled).collect()
    return learn_rules(sorted((({f: float(r[f]) for f in FEATURES}, r["label_bad"], r["label_fold"]) for r in rows), key=lambda x: (*x[0].values(), x[1], x[2])))


def label_sample(labels: DataFrame, key: str = "doc_id", label: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    known = labels.where(labels[key].isNotNull() & labels[label].isNotNull())
    mixed = F.xxhash64(known[key])
    return known.select(known[key].alias("label_key"), (known[label] == 0).alias("label_bad"), F.pmod(mixed, F.lit(997)).alias("label_fold"), mixed.alias("h")).orderBy("h", "label_bad").limit(max_labelled).drop("h")


def as_columns(rules: list[list[Condition]]) -> Column:
    """kept: false at the first rule that holds, else true."""
    verdict = None
    for rule in rules:
        test = F.expr(" AND ".join(f"({c})" for c in rule))
        verdict = F.when(test, False) if verdict is None else verdict.when(test, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """docs with the statistics, base_failed and kept (boolean), in place of any columns of these names."""
    rules = fit_rules(docs, labels, text, key, label, max_labelled)
    stats = text_statistics(docs, text)
    stats = stats.select(*others(stats, "base_failed", "kept"), base_failed().alias("base_failed"), as_columns(rules).alias("kept"))
    return stats.withColumn("kept", ~F.col("base_failed") & F.col("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
