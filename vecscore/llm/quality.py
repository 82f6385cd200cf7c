"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a Boolean expression on counts of a text, true where the text is rejected. On a bounded sample of texts each rule is
run alone: the share it rejects is its selectivity, and its cost the median of several runs over the sample, repeated until the work outweighs a
job's own time, less that of a rule that does nothing; the first run, which compiles, isn't counted. Costs are rounded to powers of two, so that noise seldom changes the order. Rules are then tried in the
order of rejections per cost, and a text that one rule rejects is not shown to the later ones (CASE WHEN
evaluates branches in order). The order changes the time and `rejected_by`, never the verdict.

Words are runs of what isn't white space (space, tab, LF, VT, FF, CR). Null and blank texts have no words:
counts are 0 and `few_words` rejects them. Ties in rejections per cost are broken by name. Rows are treated one by one: repeated rows, repeated and null ids
change nothing but the sample. An empty table gives an empty table. The words of a text, and an 8-byte hash for each window, are what a task holds of a very long one. Columns
may have any names but those of the result, which replaces them.
"""

from __future__ import annotations

import math
import statistics
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 500
REPEAT, RUNS, LEAST_COST = 4, 3, 1e-3
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def window_hashes(ws: Column, n: int = WINDOW) -> Column:
    """A hash for each n consecutive words; none if there are fewer."""
    return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n)))).otherwise(F.array().cast("array<bigint>"))


def covered_by_repeats(hashes: Column, n: int = WINDOW) -> Column:
    """Words in windows whose hash is there twice or more. Only texts that have such a window sort their windows."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"]))

    # a let binding, so that the sorted array is made once
    at = F.element_at(F.transform(F.array(order), repeated), 1)
    count = F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + n - F.greatest(p, a["end"])).alias("n"), (p + n).alias("end")),
    )["n"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), count).otherwise(0).cast("bigint")


def n_repeat_words(text: Column, n: int = WINDOW) -> Column:
    return F.element_at(F.transform(F.transform(F.array(words(text)), lambda ws: window_hashes(ws, n)), lambda h: covered_by_repeats(h, n)), 1)


Counts = Callable[[str], Column]
Rule = Callable[[Counts], Column]


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def n_lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n"))


COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("bigint"), "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words, "n_lines": n_lines, "has_letter": has_letter,
}
#: A rule rejects where it is true. It asks for counts by name, so that it can be run on texts or on counts at hand.
RULES: dict[str, Rule] = {
    "few_words": lambda c: c("n_words") < 10,
    "repeated_words": lambda c: 100 * c("n_repeat_words") > 20 * c("n_words"),
    "long_words": lambda c: c("word_chars") > 25 * F.greatest(c("n_words"), F.lit(1)),
    "symbols": lambda c: 10 * c("n_symbols") > 3 * c("n_words"),
    "repeated_lines": lambda c: 10 * c("n_dup_lines") > 3 * c("n_lines"),
    "no_letters": lambda c: ~c("has_letter"),
}


def measure(docs: DataFrame, rules: dict[str, Rule], doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, repeat: int = REPEAT) -> dict[str, tuple[float, float]]:
    """Cost (seconds for the sample, as a power of two) and share rejected of each rule, run alone on the sample_rows texts with the least id hashes."""
    ids = docs.select(doc_id).orderBy(F.xxhash64(doc_id, F.lit(11)), doc_id).limit(sample_rows).distinct()  # ids alone are sorted
    sample = docs.select(doc_id, F.col(text).alias("t")).join(F.broadcast(ids), doc_id).select("t").persist()
    n, out = sample.count(), {}
    often = sample.select("t", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("i"))

    def run(hit: Column) -> tuple[float, int]:
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            got = often.agg(F.count_if(hit), F.max("i")).first()[0]
            took.append(time.perf_counter() - start)
        return statistics.median(took[1:]), got // repeat

    idle = run(F.length("t") < 0)[0]
    for name, rule in rules.items():
        cost, hits = run(rule(lambda k: COUNTS[k](F.col("t"))))
        out[name] = (2.0 ** round(math.log2(max(cost - idle, LEAST_COST) / repeat)), hits / max(1, n))
    sample.unpersist()
    return out


def order_rules(stats: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejections per cost first."""
    return sorted(stats, key=lambda k: (-(stats[k][1] + 1e-6) / max(stats[k][0], 1e-9), k))


def quality(docs: DataFrame, rules: dict[str, Rule] | None = None, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, counts: tuple[str, ...] = ()) -> DataFrame:
    """docs with the named counts, rejected_by (the first rule of the cascade that rejects, else null) and kept; these replace columns of their names.

    Counts that are asked for are made once, for every text, and the rules use them; all other work on a text is done
    only if the cascade gets there."""
    rules = rules or RULES
    order = order_rules(measure(docs, rules, doc_id, text, sample_rows))
    out = docs.withColumns({k: COUNTS[k](F.col(text)) for k in counts}) if counts else docs
    get = lambda k: F.col(k) if k in counts else COUNTS[k](F.col(text))
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name](get), F.lit(name)).otherwise(verdict)
    return out.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())
