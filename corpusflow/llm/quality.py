"""Quality rules: an ordered decision list, learned from labelled documents.

Sequential covering: a rule is a conjunction of thresholds on text statistics that marks bad
documents. It is grown on two thirds of the labelled rows, one threshold after the other, by
FOIL's gain; then pruned from its end on the other third, by the share of bad documents it
covers there. A rule stays if the lower Wilson bound of that share is high enough; rows
that it covers are set aside and the next one is grown. The list becomes one CASE expression.

Candidate thresholds are quantiles of each statistic over all labelled rows. Each growing
step is one aggregate: rows are counted by statistic, side of the thresholds and label; at
most STATISTICS x THRESHOLDS rows come back to the driver, whatever the size of the table.

Words that repeat are found inside each row: 5-word windows are hashed and only texts with
equal hashes have their windows sorted as strings, so no word leaves its row.

Rows: a null text has no words; such rows fail the base rules. Labels are matched by doc_id;
a null id has none, several labels of one id count each. Without labels, or with one class
only, the list is empty. An empty table gives no rows. Other columns of the documents are
kept whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.store import let, stored

# Spaces, symbols, repeat windows and base limits of the contract.
SEPARATORS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = ".,;:!?"
REPEAT_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

THRESHOLDS = 24
MAX_RULES = 8
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.8
LEAST_COVER = 8
Z = 1.28


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS, -1), "")


def _gram(words: Column, at: Column) -> Column:
    return F.concat_ws(" ", *(F.get(words, at + k) for k in range(REPEAT_WINDOW)))


def _covered(positions: Column) -> Column:
    """Words covered by the windows at these sorted positions."""
    return F.aggregate(
        F.transform(
            positions,
            lambda p, k: F.when(
                k + 1 < F.size(positions), F.least(F.lit(REPEAT_WINDOW), F.get(positions, k + 1) - p)
            ).otherwise(REPEAT_WINDOW),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )


def _sorted_repeats(grams: Column) -> Column:
    """Positions, sorted, of windows equal to a neighbour in sorted order."""
    equal = lambda g, k: (F.get(grams, k)["gram"] == F.get(grams, g)["gram"])
    at = F.filter(
        F.sequence(F.lit(0), F.size(grams) - 1),
        lambda k: F.coalesce(equal(k - 1, k), F.lit(False)) | F.coalesce(equal(k + 1, k), F.lit(False)),
    )
    return F.array_sort(F.transform(at, lambda k: F.get(grams, k)["at"]))


def repeated_words(words: Column) -> Column:
    """Words that stand in a 5-word window found more than once in the text."""

    def count(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - REPEAT_WINDOW)
        hashes = F.transform(at, lambda k: F.xxhash64(*(F.get(w, k + j) for j in range(REPEAT_WINDOW))))
        grams = F.array_sort(F.transform(at, lambda k: F.struct(_gram(w, k).alias("gram"), k.alias("at"))))
        exact = let(let(grams, _sorted_repeats), _covered)
        some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when((F.size(w) > REPEAT_WINDOW) & some, exact).otherwise(0)

    return let(words, count).cast("long")


def statistics(rows: DataFrame, text: Column, *keep: Column | str) -> DataFrame:
    """``keep`` with the base statistics and ``capitals`` and ``stops`` of each text."""

    def told(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    def without(characters: str) -> Column:
        return F.length(F.translate("_text", characters, "")).cast("long")

    chars = F.length("_text").cast("long")
    lines = F.filter(F.split("_text", "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    rows = rows.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("_text"))
    kept = [n for n in rows.columns if n != "_text"]
    return rows.select(
        *kept,
        let(words_of(F.col("_text")), told).alias("_w"),
        without(SPACES).alias("word_chars"),
        (chars - without(SYMBOLS)).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        (chars - without(CAPITALS)).alias("capitals"),
        (chars - without(STOPS)).alias("stops"),
    ).select(*kept, "_w.*", "word_chars", "n_symbols", "n_dup_lines", "capitals", "stops")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The statistics that rules may bound; each is defined for empty texts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "capitals_share": F.col("capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stops_per_word": F.col("stops") / words,
        "distinct_share": F.col("n_distinct") / words,
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.col(self.measure)
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.bound!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    bad: int

    def column(self) -> Column:
        whole = F.lit(True)
        for condition in self.conditions:
            whole = whole & condition.column()
        return whole

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + f"  ({self.bad} of {self.covered} bad)"


def _all(conditions) -> Column:
    return Rule(tuple(conditions), 0, 0).column()


def wilson(bad: int, covered: int) -> float:
    """Lower bound of the share of bad rows."""
    if not covered:
        return 0.0
    share = bad / covered
    spread = Z * math.sqrt(share * (1 - share) / covered + Z * Z / (4 * covered * covered))
    return (share + Z * Z / (2 * covered) - spread) / (1 + Z * Z / covered)


def _side(name: str) -> str:
    return f"_side_{name}"


def with_sides(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Add, for each measure, the number of its thresholds below the value."""

    def below(name: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda bound: bound < F.col(name)))

    return rows.withColumns({_side(name): below(name) for name in cuts})


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """Rows and bad rows by measure and side: one aggregate over the rows."""
    sides = (F.struct(F.lit(name).alias("measure"), F.col(_side(name)).alias("side")) for name in cuts)
    found = rows.select("bad", F.explode(F.array(*sides)).alias("_s")).groupBy("_s.measure", "_s.side")
    return {
        (r["measure"], r["side"]): [r["n"], r["bad"]]
        for r in found.agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).collect()
    }


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < MAX_CONDITIONS:
        counts = _counts(rows.filter(_all(conditions)), cuts)
        first = next(iter(cuts))
        total = [sum(v[k] for (m, _), v in counts.items() if m == first) for k in (0, 1)]
        if total[1] < LEAST_COVER or total[1] == total[0]:
            break
        best, gain = None, 0.0
        for name, bounds in cuts.items():
            for k, bound in enumerate(bounds):
                below = [sum(v[j] for (m, s), v in counts.items() if m == name and s <= k) for j in (0, 1)]
                for above, (n, bad) in ((False, below), (True, [total[j] - below[j] for j in (0, 1)])):
                    if bad >= LEAST_COVER and n < total[0]:
                        more = bad * (math.log2(bad / n) - math.log2(total[1] / total[0]))
                        if more > gain + 1e-9:
                            best, gain = Condition(name, above, bound), more
        if best is None:
            break
        conditions.append(best)
    return conditions


def _prune(rows: DataFrame, conditions: list[Condition]) -> Rule | None:
    """The shortest beginning of the rule with the best lower bound on rows it was not grown on."""
    wanted = []
    for k in range(1, len(conditions) + 1):
        inside = _all(conditions[:k])
        wanted += [F.count_if(inside).alias(f"n{k}"), F.coalesce(F.sum(F.when(inside, F.col("bad"))), F.lit(0)).alias(f"b{k}")]
    if not wanted:
        return None
    row = rows.agg(*wanted).first()
    rules = [Rule(tuple(conditions[:k]), row[f"n{k}"], row[f"b{k}"]) for k in range(1, len(conditions) + 1)]
    best = max(rules, key=lambda r: (round(wilson(r.bad, r.covered), 6), -len(r.conditions)))
    return best if wilson(best.bad, best.covered) >= LEAST_PRECISION else None


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Rules that mark bad rows, in order. ``labelled`` has doc_id, ``bad`` and the measures."""
    names = list(measures())
    quantiles = [k / (THRESHOLDS + 1) for k in range(1, THRESHOLDS + 1)]
    bounds = labelled.agg(*(F.percentile_approx(n, quantiles, 10_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(bounds[n])) for n in names if bounds[n]}
    if not cuts:
        return []
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    left = stored(with_sides(labelled.withColumn("_held", held), cuts), "labelled-sides")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _prune(left.filter("_held"), _grow(left.filter("NOT _held"), cuts))
        if rule is None:
            break
        rules.append(rule)
        left = left.filter(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: number of the first rule that rejects a row, or null."""
    found = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        found = F.when(rule.column(), k).otherwise(found)
    return found


def learn_from(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Stored statistics and measures of all documents, and the rules of the labelled ones."""
    told = stored(statistics(documents, F.col("text"), "doc_id"), "text-statistics")
    told = told.withColumn("base_failed", base_failed()).withColumns(measures())
    marked = labels.filter("quality IS NOT NULL").select("doc_id", (1 - F.col("quality").cast("int")).alias("bad"))
    labelled = told.filter(~F.col("base_failed")).join(marked, "doc_id")
    return told, learn_rules(stored(labelled.select("doc_id", "bad", *measures()), "labelled-statistics"))


def quality_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    told, rules = learn_from(documents, labels)
    return told.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & verdict(rules).isNull()).alias("kept"),
        verdict(rules).alias("rule"),
    )


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that neither the base rules nor the list reject, with their own columns.

    Statistics are taken where the text is, so texts are not shuffled.
    """
    told = statistics(documents, F.col("text"), F.struct(*documents.columns).alias("_row"))
    told = told.withColumn("_failed", base_failed()).withColumns(measures())
    return told.filter(~F.col("_failed") & verdict(rules).isNull()).select("_row.*")
