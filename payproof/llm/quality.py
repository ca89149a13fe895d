"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones.

The list is learned by sequential covering. Each rule is a conjunction of thresholds, grown by information gain on two
thirds of the examples and pruned on the rest; it takes the rejected examples that it covers out, and the next rule is
learned from what is left. The list is applied as one Spark conditional expression, in order.

Nulls and empty texts have no words, and fail the base rules. Rows are judged one by one, so repeated rows and ids all
come back; other columns of the input are not looked at. Without usable labels the list is empty and keeps everything.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from payproof.llm import words as W

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: At most so many labelled documents are learned from.
SAMPLE_ROWS = 20_000

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
CONTINUES = (np.arange(256) & 0xC0) == 0x80
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)
MARKS = np.array([b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_distinct",
)
STATISTICS = "struct<" + ", ".join(f"{name}: bigint" for name in COUNTS) + ">"


def _bytes_of(kind: np.ndarray, chunk: W.Chunk) -> np.ndarray:
    return W.per_text(kind[chunk.data], chunk.offsets)


def _repeated(found: W.Words) -> np.ndarray:
    """Words of each text that lie in a window which the text holds twice or more."""
    n = len(found.starts)
    at = np.flatnonzero(W.whole_windows(found, WINDOW))
    if len(at) == 0:
        return np.zeros(len(found.by_text) - 1, np.int64)
    keys = W.keyed(W.window_hashes(found.hashes, WINDOW)[at], found.text_of[at])
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return W.per_text(W.covered(at[twice], WINDOW, n), found.by_text)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    order = np.argsort(W.keyed(keys, owner))
    ranked, owner = W.keyed(keys, owner)[order], owner[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    return np.bincount(owner[first], minlength=n)


def _lines(chunk: W.Chunk, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and its lines with a word that equal an earlier one."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.offsets[1:], breaks]), kind="stable")
    owner = np.searchsorted(breaks, chunk.offsets)
    n_lines = np.diff(owner) + 1
    text_of = np.repeat(np.arange(chunk.n), n_lines)
    full = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    hashes = W.range_hash(found.prefix, starts[full], ends[full])
    kept = np.bincount(text_of[full], minlength=chunk.n)
    return n_lines, kept - _distinct(hashes, text_of[full], chunk.n)


def count_texts(texts: pa.Array) -> pa.Array:
    """The statistics of each text, over the whole of it."""
    parts: list[list[np.ndarray]] = []
    for chunk in W.chunks(texts):
        found = W.words(chunk)
        n_lines, n_dup_lines = _lines(chunk, found)
        parts.append(
            [
                found.counts,
                _bytes_of(W.PLAIN & ~CONTINUES, chunk),
                _bytes_of(SYMBOLS, chunk),
                n_dup_lines,
                _repeated(found),
                n_lines,
                _bytes_of(UPPER, chunk),
                _bytes_of(DIGITS, chunk),
                _bytes_of(MARKS, chunk),
                _distinct(found.hashes, found.text_of, chunk.n),
            ]
        )
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(len(COUNTS))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


@functools.cache
def _count_udf():
    @arrow_udf(STATISTICS)
    def count(texts: pa.Array) -> pa.Array:
        return count_texts(texts)

    return count.asNondeterministic()  # else a filter on the result would have it run twice


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    """Every row as it is, with a struct of counts over its text."""
    return docs.withColumn(into, _count_udf()(F.col(text).cast("string")))


def base_failed(s: str = "statistics") -> Column:
    n = F.col(f"{s}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > MAX_REPEATED_PERCENT * n)


def features(s: str = "statistics") -> dict[str, Column]:
    """What rules may test: sizes, and shares of words or letters."""
    col = {name: F.col(f"{s}.{name}").cast("double") for name in COUNTS}

    def share(a: str, b: str) -> Column:
        return col[a] / F.greatest(col[b], F.lit(1.0))

    return {
        "n_words": col["n_words"],
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c, t = columns[self.feature], F.lit(float(self.threshold))
        return c > t if self.above else c <= t

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(values.values()))), bool)
        for test in self.tests:
            out &= test.holds(values)
        return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, otherwise the document is kept."""

    rules: tuple[Rule, ...] = field(default=())

    def verdict(self, columns: dict[str, Column]) -> Column:
        chain = None
        for rule in self.rules:
            condition = functools.reduce(lambda a, b: a & b, (t.column(columns) for t in rule.tests))
            chain = F.when(condition, F.lit(False)) if chain is None else chain.when(condition, F.lit(False))
        return F.lit(True) if chain is None else chain.otherwise(F.lit(True))

    def keeps(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(values.values()))), bool)
        for rule in self.rules:
            out &= ~rule.holds(values)
        return out

    def __str__(self) -> str:
        lines = ["reject if " + " and ".join(map(str, r.tests)) for r in self.rules]
        return "\n".join([*lines, "otherwise keep"])


def _thresholds(v: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Middles between neighbouring values where the label changes; evenly thinned to 64."""
    order = np.argsort(v, kind="stable")
    v, bad = v[order], bad[order]
    at = np.flatnonzero((v[1:] > v[:-1]) & ((bad[1:] != bad[:-1]) | (np.arange(1, len(v)) % max(1, len(v) // 32) == 0)))
    if len(at) > 64:
        at = at[np.linspace(0, len(at) - 1, 64).astype(int)]
    return (v[at] + v[at + 1]) / 2


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Add the threshold of highest information gain until the rule covers bad examples alone."""
    tests: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, v in values.items():
            for t in _thresholds(v[inside], bad[inside]):
                high = v[inside] > t
                p_high, all_high = (bad[inside] & high).sum(), high.sum()
                for above, p, n in ((True, p_high, all_high - p_high), (False, p0 - p_high, n0 - all_high + p_high)):
                    if p and (gain := p * (np.log2(p / (p + n)) - before)) > best[0]:
                        best = (gain, Test(name, above, float(t)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(values)
    return Rule(tuple(tests))


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on examples it was not grown from."""

    def worth(r: Rule) -> float:
        inside = r.holds(values)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    shorter = [Rule(rule.tests[: k + 1]) for k in range(len(rule.tests))]
    return max(shorter, key=worth) if shorter else rule


def learn(
    values: dict[str, np.ndarray],
    bad: np.ndarray,
    most_rules: int = 12,
    most_tests: int = 4,
    least_precision: float = 0.9,
    least_covered: int = 3,
) -> DecisionList:
    """Sequential covering of the bad examples. A rule enters only if it is precise on all the examples left."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.zeros(len(bad), bool)
    for label in (False, True):  # every third example of either label is for pruning
        third[np.flatnonzero(bad == label)[::3]] = True
    while len(rules) < most_rules and bad[left].any():
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in values.items()}, bad[grow], most_tests)
        if not rule.tests:
            break
        rule = _prune(rule, {k: v[prune] for k, v in values.items()}, bad[prune])
        inside = rule.holds(values) & left
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if p < least_covered or p < least_precision * (p + n):
            break
        rules.append(rule)
        left &= ~inside
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most sample_rows labelled documents, picked by a hash of the id.

    Their counts, a few numbers each, come to the driver. Documents that fail the base rules teach nothing.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality"))
        .where("_id is not null and _quality is not null")
        .groupBy("_id")
        .agg(F.min("_quality").alias("_quality"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(picked), "_id")
    examples = with_statistics(texts).where(~base_failed())
    rows = examples.select("_id", "_quality", *(c.alias(k) for k, c in features().items())).limit(sample_rows)
    table = rows.toPandas().sort_values("_id", kind="stable")
    bad = (table["_quality"] == 0).to_numpy()
    return learn({k: table[k].to_numpy(float) for k in features()}, bad)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Every row with its statistics, base_failed and kept."""
    verdict = ~F.col("base_failed") & rules.verdict(features())
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict)
