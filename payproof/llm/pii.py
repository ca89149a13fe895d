"""Personal data: fixed patterns, and further spans accepted by a weakly supervised classifier; no Python on the executors.

Candidate spans of several kinds are cut out of every text. Labelers vote on each: for, against, or not at all. They look
at its form, at lists of words, and at the words around it. How reliable each labeler is follows from expectation
maximisation over all candidates; the resulting probabilities train a logistic classifier over the span's own features,
and that classifier decides. Only counts by vote and feature pattern come to the driver; their number has a fixed bound.
The fixed patterns always stay.

A null text counts as an empty one. Rows are judged one by one; other columns are kept and not looked at, but for any named
base or more, which the result replaces.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fixed kinds in order. Possessive loops, and starts only at the beginning of a run or where the last match ended:
#: the same matches as with plain loops, without stack or time growing with the square of a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "phone": "+", "ip": "."}

_GROUP = r"(?:\x20?[A-Z0-9]{4})"


def _last(size: str) -> str:
    """The short last group of an account number. After a space it needs a digit, so that no word is taken for it."""
    return rf"(?:[A-Z0-9]{{{size}}}|\x20(?=[A-Z]*[0-9])[A-Z0-9]{{{size}}})(?![0-9A-Za-z])"


_TOKEN = r"[A-Za-z0-9+/_-]++={0,2}+"
_NAMED = r"(?i:key|token|secret|passw(?:or)?d|passwd|pwd|pass|auth|credentials?)\x20{0,2}[=:]\x20{0,2}"

#: A word that begins with a capital, of letters of any script, with its apostrophes and hyphens.
_CAPITAL = r"\p{Lu}['\u2019]?+[\p{L}\p{M}]++(?:['\u2019-][\p{L}\p{M}]++)*+"

#: Further kinds; each pattern is a candidate only, the classifier decides.
MORE = {
    "address": rf"(?<![0-9\p{{L}}])[0-9]++[A-Za-z]?\x20{_CAPITAL}(?:\x20{_CAPITAL})*?\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard)(?!\p{{L}})",
    "birth": r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9A-Za-z])",
    # 11 to 30 letters and digits after the check digits
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}"
    + rf"(?:{_GROUP}{{7}}{_last('1,2')}|{_GROUP}{{3,6}}{_last('1,3')}|{_GROUP}{{2}}{_last('3')}|{_GROUP}{{3,7}}(?![0-9A-Za-z]))",
    "id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"(?<!\p{{L}})(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20{_CAPITAL}(?:\x20{_CAPITAL})*+",
    # of any length, in quotes of either kind, or after a name and = or :
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})"
    + rf"(?:(?<=\"){_TOKEN}(?=\")|(?<='){_TOKEN}(?=')|(?<={_NAMED}){_TOKEN}(?![A-Za-z0-9+/_=-]))",
}
KINDS = [*BASE, *MORE]

GAZETTEER = "street avenue road lane drive boulevard smith jones miller brown garcia martin muller dupont anna maria john peter"
CUES = "mail call phone tel contact reach address born birth ssn iban account card token key secret password pass dear name"
AGAINST = "version chapter page section figure table price isbn vol no"
LEFT_CHARS = 24


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """Start, end and text of each match. Splitting by the pattern gives what lies between the matches."""
    between = F.split(text, pattern, -1)
    both = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    walked = F.aggregate(
        F.slice(both, 1, F.size(found)),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,t:string>>").alias("all")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(
                acc["all"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("s"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("e"),
                        x["hit"].alias("t"),
                    )
                ),
            ).alias("all"),
        ),
    )["all"]
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,t:string>>"))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    text = span["t"]
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        parts = F.split(F.regexp_replace(text, r"(?<![0-9])0+(?=[0-9])", ""), r"\.")
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _any_of(words: str) -> str:
    return r"(?i)(?<![a-z])(?:" + "|".join(words.split()) + r")(?![a-z])"


def _votes(kind: str, text: Column, span: Column) -> list[Column]:
    """One vote for each labeler: 1 for, -1 against, 0 not at all."""
    from_ = F.greatest(span["s"] - LEFT_CHARS, F.lit(0))
    left = F.substring(text, (from_ + 1).cast("int"), (span["s"] - from_).cast("int"))
    value = span["t"]
    n_digits = F.length(F.regexp_replace(value, "[^0-9]", ""))

    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)

    strict = {
        "email": value.rlike(r"\.[A-Za-z]{2,}$"),
        "id": ~value.rlike("^(?:000|666|9)"),
        "secret": value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
        "birth": value.rlike("19[0-9]{2}|200[0-9]"),
    }.get(kind, F.lit(kind in BASE or kind == "iban"))
    formed = F.lit(kind not in ("secret", "email", "address", "name"))  # digits are part of the form: no evidence
    return [
        vote(strict, ~strict if kind in ("secret", "id", "birth") else None),
        vote(value.rlike(_any_of(GAZETTEER)), F.lit(kind in ("name", "address"))),
        vote(left.rlike(_any_of(CUES)), left.rlike(_any_of(AGAINST))),
        vote(~formed & (n_digits * 4 >= F.length(value)), ~formed & (n_digits == 0) & F.lit(kind != "name")),
        vote(left.rlike(r"[=:]\s*[\"']?$"), left.rlike(r"[$€£#/][\s]*$")),
        vote(left.rlike(_any_of(CUES) + _JOINED), left.rlike(_any_of(AGAINST) + _JOINED)),
    ]


LABELERS = 6
#: Between a cue and what it speaks of.
_JOINED = r"(?:\s+(?:is|on|of|no|number|to|at|the|date))*[\s.:=#\"']*$"


def _features(kind: str, span: Column, votes: list[Column]) -> list[Column]:
    """Small integers, each an index into the classifier's weights."""
    n = F.length(span["t"])
    digits = F.length(F.regexp_replace(span["t"], "[^0-9]", ""))
    base = len(KINDS)
    return [
        F.lit(KINDS.index(kind)),
        base + F.when(n < 8, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3),
        base + 4 + F.floor(digits * 4 / F.greatest(n, F.lit(1))).cast("int"),
        base + 9 + votes[0] + 1,
        base + 12 + votes[2] + 1,
        *(base + 15 + 3 * i + votes[labeler] + 1 for i, labeler in enumerate((1, 3, 4, 5))),
    ]


WEIGHTS = len(KINDS) + 27


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row as it is, with base and more: arrays of the spans found, the latter with votes and features.

    Columns of these two names are replaced.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    taken = {c.lower() for c in docs.columns}
    mark = next(m for m in ("_" * k for k in range(1, len(taken) + 2)) if not any(c.startswith(m) and c[len(m) :] in KINDS for c in taken))
    hits = {}
    for kind, pattern in (BASE | MORE).items():
        hit = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        hits[mark + kind] = F.when(F.contains(whole, F.lit(_NEEDS[kind])), hit).otherwise(none) if kind in _NEEDS else hit
    out = docs.withColumns(hits)

    def described(kind: str) -> Column:
        spans = F.filter(_spans(whole, F.col(mark + kind), (BASE | MORE)[kind]), lambda x: _valid(kind, x))

        def one(x: Column) -> Column:
            votes = _votes(kind, whole, x)
            return F.struct(
                F.lit(kind).alias("kind"),
                x["s"].alias("start"),
                x["e"].alias("end"),
                F.array(*votes).alias("votes"),
                F.array(*_features(kind, x, votes)).alias("features"),
            )

        empty = F.array().cast(SPANS)
        return F.when(F.size(mark + kind) > 0, F.transform(spans, one).cast(SPANS)).otherwise(empty)

    out = out.withColumns({mark + k: described(k) for k in KINDS})
    return out.withColumns(
        {"base": F.concat(*(mark + k for k in BASE)), "more": F.concat(*(mark + k for k in MORE))}
    ).drop(*(mark + k for k in KINDS))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,votes:array<int>,features:array<int>>>"


@dataclass(frozen=True)
class Reliability:
    """What expectation maximisation found: how often spans are personal data, how labelers vote on either class."""

    prior: float
    votes: tuple[tuple[tuple[float, float], ...], ...]  # by labeler, by vote + 1, for (other, personal)

    def posterior(self, votes: Sequence[int]) -> float:
        yes, no = math.log(self.prior), math.log(1 - self.prior)
        for table, v in zip(self.votes, votes, strict=True):
            no += math.log(table[v + 1][0])
            yes += math.log(table[v + 1][1])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 30) -> Reliability:
    """Expectation maximisation over vote patterns and how often each was seen; it starts from the majority."""
    belief = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in patterns}
    total = sum(patterns.values())
    for _ in range(rounds):
        personal = sum(n * belief[v] for v, n in patterns.items())
        tables = []
        for labeler in range(LABELERS):
            table = []
            for vote in (-1, 0, 1):
                # one imagined vote each way, more of them on the side that the vote speaks for
                yes = 1.0 + (vote > 0) + sum(n * belief[v] for v, n in patterns.items() if v[labeler] == vote)
                no = 1.0 + (vote < 0) + sum(n * (1 - belief[v]) for v, n in patterns.items() if v[labeler] == vote)
                table.append((no / (total - personal + 4), yes / (personal + 4)))
            tables.append(tuple(table))
        model = Reliability((personal + 1) / (total + 2), tuple(tables))
        belief = {v: model.posterior(v) for v in patterns}
    return model


def train(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 200, decay: float = 1e-3) -> list[float]:
    """Logistic weights from (feature indexes, how many spans, probability that they are personal data)."""
    weights = [0.0] * WEIGHTS
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(rounds):
        slope = [decay * w for w in weights]
        for features, n, target in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in features)))))
            for f in features:
                slope[f] += n / total * (p - target)
        weights = [w - 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(spans: DataFrame) -> list[float]:
    """Weights from the arrays of found(). What is collected has at most one row for each vote and feature pattern."""
    one = F.explode(F.concat("base", "more")).alias("x")
    counted = spans.select(one).groupBy("x.votes", "x.features").agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[int, ...], int] = {}
    for row in counted:
        patterns[tuple(row.votes)] = patterns.get(tuple(row.votes), 0) + row.n
    if not patterns:
        return [0.0] * WEIGHTS
    model = estimate(patterns)
    ordered = sorted(counted, key=lambda r: (tuple(r.features), tuple(r.votes)))
    return train([(tuple(r.features), float(r.n), model.posterior(r.votes)) for r in ordered])


def accepted(weights: list[float]) -> Column:
    """The spans of more that the classifier takes for personal data."""
    table = F.array(*(F.lit(float(w)) for w in weights))

    def score(x: Column) -> Column:
        return F.aggregate(x["features"], F.lit(0.0), lambda a, f: a + F.get(table, f))

    return F.filter("more", lambda x: score(x) > 0)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def redacted(spans: Column, text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that begins first stands."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(
            x["s"] >= acc["at"],
            F.struct(
                x["e"].alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")),
                        F.concat(F.lit("["), F.upper(x["k"]), F.lit("]")),
                    ),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(1 << 30))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)
