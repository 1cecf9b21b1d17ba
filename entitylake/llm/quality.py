"""Quality rules: statistics of whole texts and a learned decision list, in DataFrame operations alone.

Statistics are columns of the text's own row, nothing is shuffled: words and lines are arrays, windows of eight
words are hashed by three steps of doubling (one, two, four, eight words), and only texts that repeat a window
sort theirs to find which.

The decision list is learned by sequential covering on a bounded sample of labelled rows (``max_labelled``, those
with the least digest of their id): a rule grows by the threshold with the most information gain until it covers
no good row of the growing part, is pruned on the other part, and what it covers is taken out, as long as a rule
is right often enough. Rules become one ordered conditional expression.

Defined cases: a null or blank text has no words and fails the base rules. A document without label only lacks a
vote in learning; a null label is none, of several labels the worst counts. Without labels of both kinds nothing
is learned and all that pass the base rules stay. Null and repeated ids are judged each. An empty table gives no
rows. Columns of the input keep their names whatever they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm import common

# The separators of words, the characters counted as symbols, the words of a window.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The input's columns as ``row``, with the statistics of its text."""
    text = common.whole_text(text_column)
    df = docs.select(F.struct("*").alias("row"), text.alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    words = F.when(trimmed == "", none).otherwise(F.split(trimmed, common.SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.select("row", "text", words.alias("words"), lines.alias("lines"))
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    rest = ("row", *STATS[:4])
    for step in (1, 2, 4):
        after = F.slice("h", F.lit(step + 1), F.greatest(F.size("h") - step, F.lit(0)))
        df = df.select(*rest, F.zip_with("h", after, lambda a, b: F.xxhash64(a, b)).alias("h"))
    df = df.select(*rest, F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))).alias("h"))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    places = F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*rest, places.alias("z"))
    df = df.select(*rest, "z", F.col("z.h").alias("zh"))
    gap, n = F.array(F.lit(None).cast("long")), F.size("zh")
    before = F.concat(gap, F.slice("zh", F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("zh", F.lit(2), F.greatest(n - 1, F.lit(0))), gap)
    neighbours = F.arrays_zip(F.col("z"), before.alias("p"), after.alias("q"))
    twice = F.filter(neighbours, lambda x: (x["z"]["h"] == x["p"]) | (x["z"]["h"] == x["q"]))
    df = df.select(*rest, F.sort_array(F.transform(twice, lambda x: x["z"]["i"])).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        "at", start,
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return df.select(*rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: What rules look at: a statistic, and what it is divided by, if anything.
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", None),
    "duplicate_lines_per_word": ("n_dup_lines", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        part, whole = FEATURES[self.feature]
        value = F.col(part).cast("double") / (F.col(whole) if whole else F.lit(1))
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(n, bool)


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The threshold with the most information gain for bad rows, halfway between two values."""
    p, n = bad.sum(), (~bad).sum()
    before, best, found = np.log2(p / (p + n)), 0.0, None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        low_p, low_n = np.cumsum(b)[edge], np.cumsum(~b)[edge]
        for above, ps, ns in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0.0)
            if len(gain) and gain.max() > best + 1e-9:
                at = edge[int(np.argmax(gain))]
                best, found = gain.max(), Condition(name, above, float(v[at] + v[at + 1]) / 2)
    return found


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        inside = _covered(rule, x, len(bad))
        if not bad[inside].any() or bad[inside].all():
            break
        condition = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
        if condition is None:
            break
        rule = (*rule, condition)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is worth most on these rows, its precision and how many bad rows it covers."""
    best = ((), 0.0, 0)
    for length in range(1, len(rule) + 1):
        inside = _covered(rule[:length], x, len(bad))
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        # Laplace's estimate: a few rows prove little.
        precision = (p + 1) / (p + n + 2)
        if precision >= best[1]:
            best = (rule[:length], precision, p)
    return best


def cover(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows, in order. Every third row prunes, the others grow."""
    rules: list[Rule] = []
    n = len(bad)
    prunes = np.arange(n) % 3 == 2
    left = np.ones(n, bool)
    while len(rules) < max_rules:
        grow, prune = np.flatnonzero(left & ~prunes), np.flatnonzero(left & prunes)
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions)
        rule, precision, _ = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        if not rule or precision < min_precision:
            break
        rules.append(rule)
        left &= ~_covered(rule, x, n)
    return rules


def learn(
    measured: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    label_column: str = "quality",
    max_labelled: int = 20_000,
    min_precision: float = 0.9,
) -> list[Rule]:
    """The decision list. ``measured``: id and statistics; label 0 is bad. Rows that the base rules reject don't count."""
    votes = labels.filter(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("labelled")).agg(
        F.min(label_column).alias("label")
    )
    rows = measured.filter(~base_failed()).select(F.col(id_column).alias("id"), *STATS).join(votes, F.col("id") == F.col("labelled"))
    rows = rows.select("id", *STATS, "label")
    sample = common.least(rows, common.hash60(F.col("id")), max_labelled).collect()
    if not sample:
        return []
    stats = {name: np.array([r[name] for r in sample], float) for name in STATS}
    x = {name: stats[part] / stats[whole] if whole else stats[part] for name, (part, whole) in FEATURES.items()}
    return cover(x, np.array([r.label == 0 for r in sample]), min_precision)


def kept(rules: list[Rule]) -> Column:
    """The base rules, then the learned ones in order; what none of them rejects is kept."""
    verdict = F.when(base_failed(), False)
    for rule in rules:
        holds = rule[0].column()
        for condition in rule[1:]:
            holds &= condition.column()
        verdict = verdict.when(holds, False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per document its id, the statistics, base_failed and kept."""
    measured = common.stored(measure(docs, text_column).select(F.col("row")[id_column].alias(id_column), *STATS), "quality")
    rules = learn(measured, labels, id_column, **options)
    return measured.select("*", base_failed().alias("base_failed"), kept(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that are kept, with all columns. Statistics are stored by digest, texts are not: equal texts have one verdict."""
    key = common.row_key("row." + id_column, "row." + text_column)
    measured = common.stored(measure(docs, text_column).select(F.col("row")[id_column].alias(id_column), key[1], *STATS), "quality")
    rules = learn(measured, labels, id_column, **options)
    # Only what is rejected meets texts. The hash of the id spreads equal texts over tasks, it decides nothing.
    spread = F.xxhash64(F.col(id_column)).alias("spread")
    rejected = measured.filter(~kept(rules)).select("digest", spread).distinct()
    rows = docs.select(F.struct("*").alias("row"), common.row_key(id_column, text_column)[1], spread)
    return rows.join(rejected, ["digest", "spread"], "left_anti").select("row.*")
