"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import stored

#: Rows, about, on which costs and rejection rates are estimated, and how often each is judged for that.
SAMPLE_ROWS, SAMPLE_PASSES = 2000, 20
SYMBOLS = "#*$%&|<>"
_DIGITS = "0123456789"
_RULE_COLUMN = "text"


@dataclass(frozen=True)
class Rule:
    """A named test over ``text`` and the base columns; true rejects, null doesn't."""

    name: str
    rejects: Column | str

    def column(self) -> Column:
        found = F.expr(self.rejects) if isinstance(self.rejects, str) else self.rejects
        return F.coalesce(found, F.lit(False))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""
    last = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(
        F.slice(words, F.lit(1), last),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        covered = F.transform(F.array_compact(marked), lambda i: F.array(i, i + 1, i + 2))
        return F.size(F.array_distinct(F.flatten(covered))).cast("long")

    return T.let(F.sort_array(windows), places)


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that every document gets, and the two base tests.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_lines``
    (lines with a word) and ``n_repeat_words``.  Null text counts as empty.
    Everything is computed within the row, without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, T.SPACES, "")) > 0)
    counted = T.let(T.words(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    lined = T.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    out = docs.withColumn("_counted", counted).withColumn("_lined", lined)
    return out.select(
        *docs.columns,
        F.col("_counted.n").alias("n_words"),
        F.length(F.translate(text, T.SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.col("_lined.n") - F.col("_lined.d")).alias("n_dup_lines"),
        F.col("_lined.n").alias("n_lines"),
        F.col("_counted.r").alias("n_repeat_words"),
    )


def _share(characters: str, percent: int) -> Column:
    text = F.col(_RULE_COLUMN)
    return (F.length(text) - F.length(F.translate(text, characters, ""))) * 100 > F.length(text) * percent


def default_rules() -> list[Rule]:
    """Rules beyond the base ones; their thresholds leave ordinary prose and lists alone."""
    return [
        Rule("symbols", "n_symbols * 10 > n_words"),
        Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
        Rule("repeated_lines", "n_dup_lines * 100 > 50 * n_lines"),
        Rule("capitals", _share(T.UPPER, 30)),
        Rule("digits", _share(_DIGITS, 30)),
        Rule("wordless", F.regexp_count(F.col(_RULE_COLUMN), F.lit(r"\p{L}[^\x20\x09-\x0D]*")) * 2 < F.col("n_words")),
    ]


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Order rules by rejections per second of evaluation on ``sample``.

    ``sample`` should be small and stored.  Every rule is run over it alone,
    SAMPLE_PASSES times a row so that its cost stands out of the job's own,
    twice, and the quicker run counts; the run over no rule at all is taken off.
    The order changes what a document costs and never its verdict.
    """
    sample = sample.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_PASSES))))

    def measure(test: Column) -> tuple[float, float]:
        best, rate = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            rate = sample.agg(F.avg(test.cast("double")).alias("r")).first()["r"] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, rate

    floor, _ = measure(F.length(_RULE_COLUMN) < 0)
    gain = {}
    for rule in rules:
        seconds, rate = measure(rule.column())
        gain[rule.name] = rate / max(seconds - floor, 1e-4)
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def _tested(base: DataFrame) -> DataFrame:
    return base_measures(base, _RULE_COLUMN).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def quality_cascade(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11
) -> DataFrame:
    """Measure every document and judge it by a cascade of rules.

    Returns ``doc_id``, the base measures (``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``), ``base_failed`` (fewer
    than 50 words, or over half of the words in repeated three-word windows) and
    ``kept``, one row for each input row; rows and ids may repeat or be null.

    A document that fails the base tests is out.  The others meet the rules one
    by one, in a CASE expression that stops at the first rejection; the rules'
    order comes from their measured cost and rejection rate on about
    ``sample_rows`` rows, drawn by a hash of id and text.  Null and blank texts have no words and fail the base
    test.  An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias(_RULE_COLUMN))
    measured = _tested(base)
    rules = default_rules() if rules is None else rules
    if len(rules) > 1:
        # a hash picks the rows before they are measured, so that the rest is only counted
        one_in = max(1, docs.count() // sample_rows)
        drawn = base.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", _RULE_COLUMN), F.lit(one_in)) == 0)
        rules = order_rules(stored(_tested(drawn).where("NOT base_failed"), "quality_sample"), rules)
    verdict = F.when(F.col("base_failed"), False)
    for rule in rules:
        verdict = verdict.when(rule.column(), False)
    return measured.withColumn("kept", verdict.otherwise(True)).drop(_RULE_COLUMN, "n_lines")
