"""Quality rules as a learned decision list, in DataFrame functions only.

Sequential covering learns the list from labelled statistics: a rule, a conjunction of thresholds, is grown
condition by condition on two thirds of the labelled rows, pruned on the last third, and kept while it is
precise there; the rows that it covers leave, and the next rule is learned from the rest. The list becomes
one ordered conditional expression over the statistics of every document.

The classifier is fitted on a bounded sample of labelled rows: the ``LABELLED`` smallest hashes of doc_id.
Nothing else is sampled.

Defined cases: a null text has no word and all its counts are 0, so it fails the base rule; white space alone
likewise; a word is as long as it is, and lines are compared whole; labels that are null are left
out; without labels of both kinds the list is empty and the base rule alone decides; repeated rows
each keep their verdict; extra columns of either table are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, UPPER

#: Labelled rows that the list is learned from, at most.
LABELLED = 4096
#: Bounds of the list: conditions in a rule, rules, and the share of a rule's pruning rows that must be of bad quality.
CONDITIONS, RULES, PRECISION = 4, 12, 0.97
#: A rule rests on so many bad rows of its growing and pruning rows at least.
SUPPORT = (6, 3)

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_lines_per_line", "repeat_share", "upper_share", "digit_share", "marks_per_word", "distinct_share")


def removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS (long) and FEATURES (double, but n_words) of each whole text.

    n_repeat_words finds three-word windows of equal 64-bit hashes, sorted within a text only where two are equal, and
    then compares their words, so a collision of hashes counts nothing; the words that repeated windows cover count once.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("__text", t)
    df = df.withColumn("__words", F.filter(F.split(F.translate("__text", SPACES, " " * len(SPACES)), " "), lambda w: w != ""))
    df = df.withColumn("__n", F.size("__words"))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: F.length(removed(line, SPACES)) > 0))
    word = lambda i: F.get(F.col("__words"), i)
    windows = F.transform(F.sequence(F.lit(0), F.col("__n") - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    df = df.withColumn("__h", F.when(F.col("__n") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda k: F.coalesce(F.get(F.col("__sorted"), k)["h"], F.lit(None).cast("bigint"))
    twice = F.array_compact(F.transform("__sorted", lambda x, k: F.when((F.when(k > 0, near(k - 1)) == x["h"]) | (near(k + 1) == x["h"]), x["i"])))
    df = df.withColumn("__twice", twice)
    df = df.withColumn("__spelled", F.sort_array(F.transform("__twice", lambda i: F.struct(F.array(word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i")))))
    same = lambda x, k: F.coalesce(F.get(F.col("__spelled"), k)["w"] == x["w"], F.lit(False))
    repeated = F.filter("__spelled", lambda x, k: same(x, k - 1) | same(x, k + 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    df = df.withColumns({
        "n_words": F.col("__n").cast("long"),
        "word_chars": F.length(removed(F.col("__text"), SPACES)).cast("long"),
        "n_symbols": (F.length("__text") - F.length(removed(F.col("__text"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"),
    })
    share = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    dropped = lambda characters: F.length("__text") - F.length(removed(F.col("__text"), characters))
    n = F.col("n_words")
    df = df.withColumns({
        "chars_per_word": share(F.col("word_chars"), n),
        "symbols_per_word": share(F.col("n_symbols"), n),
        "dup_lines_per_line": share(F.col("n_dup_lines"), F.size("__lines")),
        "repeat_share": share(F.col("n_repeat_words"), n),
        "upper_share": share(dropped(UPPER), F.col("word_chars")),
        "digit_share": share(dropped("0123456789"), F.col("word_chars")),
        "marks_per_word": share(dropped(".,;:!?"), n),
        "distinct_share": share(F.size(F.array_distinct("__words")), n),
    })
    return df.drop("__text", "__words", "__n", "__lines", "__h", "__sorted", "__twice", "__spelled")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """Conditions (feature, sign, threshold), each the one of the largest FOIL gain, until no good row is covered."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        before, best = np.log2(p / (p + n)), (0.0, None)
        rows, of_bad = x[inside], bad[inside]
        for f in range(x.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            v, b = rows[order, f], of_bad[order]
            at = np.flatnonzero(v[1:] > v[:-1])
            below_p = np.cumsum(b)[at]
            below_n = at + 1 - below_p
            for sign, ps, ns in (("<=", below_p, below_n), (">", p - below_p, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0.0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (f, sign, float((v[at[i]] + v[at[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= covers(rule[-1:], x)
    return rule


def covers(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for f, sign, t in rule:
        inside &= x[:, f] <= t if sign == "<=" else x[:, f] > t
    return inside


def prune(rule: list, x: np.ndarray, bad: np.ndarray) -> list:
    """The rule's beginning of the best (bad - good) / covered on the pruning rows; the shorter one of equals."""
    best, at = -1.0, len(rule)
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], x)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-9:
            best, at = worth, k
    return rule[:at]


def learn(rows: list[tuple[float, ...]], bad: list[bool]) -> list[list[tuple[int, str, float]]]:
    """The decision list, most trusted rule first as found; every third row prunes."""
    x, y, rules = np.array(rows, float).reshape(len(rows), len(FEATURES)), np.array(bad, bool), []
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < RULES and y[~third].sum() >= SUPPORT[0] and (~y).any():
        rule = grow(x[~third], y[~third])
        if not rule:
            break
        rule = prune(rule, x[third], y[third])
        inside = covers(rule, x)
        p, n = (y & inside & third).sum(), (~y & inside & third).sum()
        if p < SUPPORT[1] or p < PRECISION * (p + n) or (y & inside & ~third).sum() < SUPPORT[0]:
            break
        rules.append(rule)
        x, y, third = x[~inside], y[~inside], third[~inside]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[tuple[float, ...]], list[bool]]:
    """Features and verdicts of at most ``bound`` labelled documents, in the order of their ids' hashes."""
    key = F.xxhash64("doc_id")
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(key, "doc_id", "quality").limit(bound)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``bound`` rows are broadcast
    rows = statistics(own).select("doc_id", "quality", *FEATURES).orderBy(key, "doc_id", *FEATURES, "quality").limit(bound).collect()
    return [tuple(float(r[f]) for f in FEATURES) for r in rows], [r.quality == 0 for r in rows]


def as_column(rules: list[list[tuple[int, str, float]]]) -> Column:
    """The list as one conditional expression: the number of the first rule that covers a row, else null."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        test = F.lit(True)
        for f, sign, t in rules[i]:
            test &= F.col(FEATURES[f]) <= t if sign == "<=" else F.col(FEATURES[f]) > t
        out = F.when(test, F.lit(i + 1)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """docs with COUNTS, base_failed, rule (the number of the learned rule that rejects it) and kept.

    docs has doc_id and text, labels doc_id and quality (0: bad). Columns of docs with the names of the verdicts give way,
    all others stay as they are, whatever their names.
    """
    made = (*COUNTS, "base_failed", "rule", "kept")
    rules = learn(*labelled_sample(docs, labels, bound))
    own = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    out = statistics(own).withColumn("base_failed", base_failed()).withColumn("rule", as_column(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c not in made), *made)


def accepted(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps.

    The filter also names a row number, which keeps the optimizer from substituting the whole conditional
    expression, arrays and all, into a filter below the columns that it is made of.
    """
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row"))
    judged = judge(whole, labels, bound).select("kept", "whole_row", F.monotonically_increasing_id().alias("at"))
    return judged.where(F.col("kept") & (F.col("at") >= 0)).select(*(F.col("whole_row")[c].alias(c) for c in docs.columns))
