"""Quality rules: text statistics as columns and a learned decision list.

The list is learned by sequential covering. A rule is a conjunction of thresholds on
statistics, grown one condition at a time by information gain on one part of the
labelled sample and pruned on the other; rows a rule covers leave the sample before
the next rule is grown. The result is an ordered CASE expression. Everything that
touches text is a DataFrame function; the driver sees only the bounded sample's numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import let

# Bound of the labelled sample, drawn by a hash of the id.
SAMPLE = 20_000
THRESHOLDS = 24
MAX_CONDITIONS = 3
MAX_RULES = 12
# A rule stays only if at least this share of what it covers in the pruning part is bad.
PRECISION = 0.97
MIN_COVERED = 8

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50


def _repeated(words: Column) -> Column:
    """Words in three-word windows that stand twice or more in the list."""

    def covered(at: Column) -> Column:
        # Sorted starts: each covers up to three words, fewer if the next start is nearer.
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda n, x: n + x
        )

    def starts(grams: Column, twice: Column) -> Column:
        few = F.array_compact(F.transform(grams, lambda g, i: F.when(F.array_contains(twice, g), i)))
        # With many repeated windows a sort finds them without a search for each.
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        many = let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))),
            lambda x: x["i"],
        )))
        return F.when(F.size(twice) <= 32, few).otherwise(many)

    def count(grams: Column) -> Column:
        twice = let(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda g, i: F.coalesce(F.get(s, i - 1) == g, F.lit(False)))))
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0)).otherwise(let(starts(grams, t), covered)))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row's whole text, null text as empty.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
    n_distinct are counts; the shares that rules use are in SHARES.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def all_of(t: Column) -> Column:
        words = F.array_remove(F.split(t, SPACE), "")
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
        return let(words, lambda w: let(lines, lambda l: F.struct(
            F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOL, ""))).cast("bigint").alias("n_symbols"),
            F.size(l).cast("bigint").alias("n_lines"), (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
            _repeated(w).cast("bigint").alias("n_repeat_words"),
            (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("bigint").alias("n_capitals"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
        )))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), let(text, all_of).alias("_stats_")).select("doc_id", "_stats_.*")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


#: What conditions may test, by name.
SHARES: dict[str, Callable[[], Column]] = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "repeated_words": lambda: _share("n_repeat_words", "n_words"),
    "repeated_lines": lambda: _share("n_dup_lines", "n_lines"),
    "capitals": lambda: _share("n_capitals", "word_chars"),
    "distinct_words": lambda: _share("n_distinct", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    share: str
    above: bool
    limit: float

    def holds(self, row: Sequence[float]) -> bool:
        value = row[list(SHARES).index(self.share)]
        return value > self.limit if self.above else value <= self.limit

    def column(self) -> Column:
        value = SHARES[self.share]()
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.share} {'>' if self.above else '<='} {self.limit:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: Sequence[float]) -> bool:
    return all(c.holds(row) for c in rule)


def _counts(rule: Rule, rows: Sequence[tuple[Sequence[float], bool]]) -> tuple[int, int]:
    bad = [is_bad for row, is_bad in rows if _covers(rule, row)]
    return sum(bad), len(bad)


def _candidates(rows: Sequence[tuple[Sequence[float], bool]]) -> list[Condition]:
    """Thresholds halfway between neighbouring quantiles of the bad rows and of all rows."""
    found = []
    for k, share in enumerate(SHARES):
        limits = set()
        for values in (sorted({row[k] for row, _ in rows}), sorted(row[k] for row, bad in rows if bad)):
            for i in range(1, THRESHOLDS):
                at = i * (len(values) - 1) // THRESHOLDS
                if at + 1 < len(values) and values[at] < values[at + 1]:
                    limits.add((values[at] + values[at + 1]) / 2)
        found += [Condition(share, above, limit) for limit in sorted(limits) for above in (True, False)]
    return found


def learn(rows: Sequence[tuple[Sequence[float], bool]]) -> list[Rule]:
    """Ordered rules for bad rows from (shares, bad). Ties go to the first condition in
    the order of SHARES and thresholds, so equal samples give equal lists."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and any(bad for _, bad in grow):
        rule: Rule = ()
        left = grow
        while len(rule) < MAX_CONDITIONS:
            bad, n = sum(b for _, b in left), len(left)
            if not bad or bad == n:
                break
            best, best_gain, best_left = None, 1e-9, left
            for condition in _candidates(left):
                inside = [r for r in left if condition.holds(r[0])]
                p = sum(b for _, b in inside)
                if p:
                    gain = p * (log2(p / len(inside)) - log2(bad / n))
                    if gain > best_gain:
                        best, best_gain, best_left = condition, gain, inside
            if best is None:
                break
            rule, left = (*rule, best), best_left
        # Drop last conditions while that does not lower (bad - good) / covered on the other part.
        def worth(r: Rule) -> float:
            p, n = _counts(r, prune)
            return (2 * p - n) / n if n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        bad, covered = _counts(rule, prune)
        if not rule or covered < MIN_COVERED or bad < PRECISION * covered:
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not _covers(rule, r[0])], [r for r in prune if not _covers(rule, r[0])]
    return rules


def rule_number(rules: Sequence[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    number = F.lit(None).cast("int")
    out = F
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        out = out.when(test, F.lit(k))
    return F.coalesce(out if rules else number, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[tuple[float, ...], bool]]:
    """Shares and verdicts of at most SAMPLE labelled documents, chosen by a hash of
    the id; labels without a quality are left out, repeated labels count once as their lowest."""
    chosen = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(texts.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")
    got = rows.select("doc_id", "quality", *(make().alias(name) for name, make in SHARES.items())).orderBy("doc_id", *SHARES).collect()
    return [(tuple(float(r[s]) for s in SHARES), r.quality == 0) for r in got]


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, statistics, base_failed, rule, kept) for every row.

    Null and empty texts have no words and fail the base rules, as does any text of
    under MIN_WORDS words or with more than half of its words in repeated windows.
    Every row is judged by itself, so repeated rows and ids get their own verdicts;
    other columns are not read; without rules the base rules alone decide.
    """
    stats = statistics(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rule_number(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn the list from labelled rows (doc_id, quality) and judge every row of docs."""
    return judge(docs, learn(sample(docs, labels)))
