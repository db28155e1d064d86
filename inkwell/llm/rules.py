"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from statistics import median
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SPACE_RUN, let, materialise, words

#: Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample that costs are estimated on, timed runs of a rule on it, and the least seconds that are told apart.
SAMPLE_ROWS, RUNS, LEAST_SECONDS = 400, 5, 1 / 128


def _count(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]++", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE_RUN, "") != "")


def duplicates(items: Column) -> Column:
    """How many items equal an earlier one."""
    return let(items, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeated_words(parts: Column, window: int = WINDOW) -> Column:
    """Words within windows that occur twice or more, each word once.

    Windows are compared by a 64-bit hash of their words' hashes. Only where some window recurs are they sorted with their places;
    the words covered are then the sum of the steps between such windows, each step at most a window long. O(n log n).
    """
    hashes = F.transform(parts, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            placed,
            lambda p: F.filter(
                F.transform(p, lambda x, i: F.when((F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        steps = lambda a: F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(a, k + 1) - x, F.lit(window)))), F.lit(0), lambda s, x: s + x)
        return let(F.array_sort(again), steps).cast("long")

    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(parts) >= window, counted).otherwise(F.lit(0).cast("long"))


#: What rules ask about: of a text without nulls and the array of its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, parts: F.size(parts).cast("long"),
    "word_chars": lambda text, parts: F.length(F.array_join(parts, "")).cast("long"),
    "n_symbols": lambda text, parts: _count(text, SYMBOLS),
    "n_capitals": lambda text, parts: _count(text, "A-Z"),
    "n_lines": lambda text, parts: F.size(lines_with_words(text)).cast("long"),
    "n_dup_lines": lambda text, parts: duplicates(lines_with_words(text)),
    "n_repeat_words": lambda text, parts: repeated_words(parts),
}


class Rule(NamedTuple):
    """rejects(measure): true where the rule rejects; measure(name) is the measure of that name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


#: The first two are the base rules.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: _share(m("n_repeat_words"), m("n_words"), 20)),
    Rule("symbols", lambda m: _share(m("n_symbols"), m("n_words"), 20)),
    Rule("repeated_lines", lambda m: _share(m("n_dup_lines"), m("n_lines"), 60)),
    Rule("capitals", lambda m: _share(m("n_capitals"), m("word_chars"), 60)),
    Rule("word_length", lambda m: (2 * m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 30 * m("n_words"))),
)


def measured(text: Column, parts: Column, given: dict[str, Column] | None = None) -> Callable[[str], Column]:
    """The measures of a text: columns where they are given, else expressions that are evaluated where they are asked for."""
    return lambda name: (given or {}).get(name, MEASURES[name](text, parts))


def planned(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", given: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejections per second, each with its share of rejections and its seconds, as measured on a sample.

    given: measures that are computed anyway, so that rules get them for nothing. A rule is run once to warm up, code and caches,
    then timed RUNS times; its cost is the median beyond that of a run without any rule, as a power of two of LEAST_SECONDS, so that
    noise doesn't turn the order. Equal rules stay in the order given. The order decides only what is evaluated, never the
    verdict: a document is rejected if any rule rejects it. So a sample of at most sample_rows suits every size.
    """
    sample = documents.select(F.coalesce(text, F.lit("")).alias("text")).limit(sample_rows).withColumn("parts", words(F.col("text")))
    names = {name: F.col(f"m_{name}") for name in given}
    rows = materialise(sample.select("text", "parts", *[MEASURES[n](F.col("text"), F.col("parts")).alias(f"m_{n}") for n in given])).coalesce(1)
    measure = measured(F.col("text"), F.col("parts"), names)

    def timed(asked: DataFrame) -> tuple[float, float]:
        share, seconds = asked.first().share or 0.0, []
        for _ in range(RUNS):
            began = time.perf_counter()
            asked.first()
            seconds.append(time.perf_counter() - began)
        return share, median(seconds)

    touched = F.sum(F.size("parts") + F.length("text"))
    _, idle = timed(rows.select(touched, F.max(F.lit(0.0)).alias("share")))
    found = []
    for rule in rules:
        share, seconds = timed(rows.select(touched, F.avg(rule.rejects(measure).cast("double")).alias("share")))
        found.append((rule, share, LEAST_SECONDS * 2.0 ** max(0, round(math.log2(max(LEAST_SECONDS, seconds - idle) / LEAST_SECONDS)))))
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(plan: list[tuple[Rule, float, float]], measure: Callable[[str], Column]) -> Column:
    """The first rule that rejects, null if none does; a CASE evaluates no branch behind the one that holds."""
    case = None
    for rule, _, _ in plan:
        hit = F.coalesce(rule.rejects(measure), F.lit(False))
        case = F.when(hit, F.lit(rule.name)) if case is None else case.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if case is None else case


def passing(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects; a null text counts as empty; other columns pass as they are, whatever their names.

    A document's measures are computed as far as the cascade asks for them. Repeated rows are judged one by one; an empty table stays empty.
    """
    plan = planned(documents, rules, text)
    body = F.coalesce(documents[text], F.lit(""))
    return documents.filter(let(words(body), lambda parts: cascade(plan, measured(body, parts))).isNull())


def documents_judged(documents: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every whole text.

    The counts are part of the result, so they are computed once, and the cascade reads them; what else its rules ask for is
    computed only for documents that no rule before rejects. Null and empty texts have no words and fail; repeated rows are judged
    one by one; an empty table stays empty.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    plan = planned(documents, given=counts)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("parts", words(F.col("text")))
    rows = rows.select("doc_id", "text", "parts", *[MEASURES[n](F.col("text"), F.col("parts")).alias(n) for n in counts])
    measure = measured(F.col("text"), F.col("parts"), {n: F.col(n) for n in counts})
    base = F.lit(False)
    for rule in RULES[:2]:
        base = base | rule.rejects(measure)
    return rows.select("doc_id", *counts, base.alias("base_failed"), cascade(plan, measure).isNull().alias("kept"))
