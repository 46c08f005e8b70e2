"""Ranking columns: parse a ranked response and score it against pass rates.

A ranking is an array of 0-based candidate positions, best first. All scores work
inside one row, so they run the same on a batch table and on a stream.
"""

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fx
from .short_lists import FEW, METRICS, short_metrics
from .text import let

FAILED = -1.0
SCORES = ("score", *METRICS)
#: Decimal digits beyond ASCII, and what they stand for.
OTHER_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdecimal()]
PLAIN_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def parse_ranking(response: Column, n_candidates: Column) -> Column:
    """The ranking named in a response, or null unless every candidate appears.

    Numbers after the last end-of-thinking mark count; longer than four digits, out of
    range, or seen before do not.
    """
    return let(named_candidates(response, n_candidates), lambda ids: complete(ids, n_candidates))


def named_candidates(response: Column, n_candidates: Column) -> Column:
    """The numbers from 1 to `n_candidates` that a response names, each once, as first named."""
    answer = ascii_digits(F.substring_index(response, fx.THINK_END, -1))
    numbers = F.regexp_extract_all(answer, F.lit(fx.SHORT_NUMBER), F.lit(0)).cast("array<int>")
    # The intersection keeps the order and the first occurrences of its left side.
    named = F.array_intersect(numbers, F.sequence(F.lit(1), n_candidates))
    return F.when(n_candidates > 0, named)


def complete(ids: Column, n_candidates: Column) -> Column:
    """The numbers as 0-based positions, if all are there."""
    return F.when(F.size(ids) == n_candidates, F.transform(ids, lambda i: i - 1))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as 0 to 9; texts in ASCII are passed through."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.translate(text, "".join(OTHER_DIGITS), PLAIN_DIGITS)
    )


def _gain(rates: Column, candidates: Column | None = None) -> Column:
    """Discounted sum of 2^rate - 1, in the given order or that of the candidates.

    A candidate without a rate adds nothing.
    """

    def term(item, i):
        rate = item if candidates is None else F.get(rates, item)
        gain = (F.pow(F.lit(2.0), rate) - 1) / F.log2((i + 2).cast("double"))
        return F.coalesce(gain, F.lit(0.0))

    terms = F.transform(rates if candidates is None else candidates, term)
    return F.aggregate(terms, F.lit(0.0), lambda total, gain: total + gain)


def _unless_missing(ranking: Column, rates: Column, value: Column) -> Column:
    """Null for a null ranking or null rates, 0 for empty ones, else the value."""
    return F.when(
        ranking.isNotNull() & rates.isNotNull(),
        F.when((F.size(ranking) == 0) | (F.size(rates) == 0), 0.0).otherwise(value),
    )


def ndcg(ranking: Column, rates: Column, k: int | None = None) -> Column:
    """Normalised discounted cumulative gain, over the first k places when k is given."""
    ideal = F.sort_array(rates, asc=False)
    seen = ranking
    if k is not None:
        ideal, seen = F.slice(ideal, 1, k), F.slice(ranking, 1, k)
    share = F.try_divide(_gain(rates, seen), _gain(ideal))
    return _unless_missing(ranking, rates, F.coalesce(share, F.lit(1.0)))


def top1_acc(ranking: Column, rates: Column) -> Column:
    """1 when the first choice has the highest rate, or all rates are equal."""
    best = F.array_max(rates)
    hit = (F.array_min(rates) == best) | (F.get(rates, F.get(ranking, F.lit(0))) == best)
    return _unless_missing(ranking, rates, F.when(hit, 1.0).otherwise(0.0))


def _tally(right, wrong) -> Column:
    return F.struct(right.alias("right"), wrong.alias("wrong"))


def _add(total, item) -> Column:
    return _tally(total["right"] + item["right"], total["wrong"] + item["wrong"])


def _share_right(total) -> Column:
    right, wrong = total["right"].cast("double"), total["wrong"].cast("double")
    return F.coalesce(F.try_divide(right, right + wrong), F.lit(1.0))


def _share_of_few(order: Column) -> Column:
    """Share of the unequal pairs that stand in falling order, by what comes after each item."""

    def later(item, i):
        after = F.slice(order, i + 2, F.size(order))
        below, above = F.filter(after, lambda o: o < item), F.filter(after, lambda o: o > item)
        return _tally(F.size(below), F.size(above))

    return F.aggregate(F.transform(order, later), _tally(F.lit(0), F.lit(0)), _add, _share_right)


def _before(values: Column, value: Column, also_equal: bool) -> Column:
    """How many of the sorted values are below the value, or not above it; by halving."""

    def halve(at, _):
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_ = at["low"] < at["high"]
        here = F.get(values, middle)
        up = open_ & ((here <= value) if also_equal else (here < value))
        return F.struct(
            F.when(up, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(open_ & ~up, middle).otherwise(at["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(steps, start, halve)["low"]


def _share_of_many(order: Column) -> Column:
    """The same by merging: sorted runs are joined two by two, and pairs counted across each two.

    Rounds grow with the logarithm of the length, a round's work with the length times its
    logarithm.
    """
    none = _tally(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))

    def merged(runs, k):
        left = F.get(runs, 2 * k)
        right = F.coalesce(F.get(runs, 2 * k + 1), F.array().cast("array<double>"))
        # Of equal items those of the first run count once, for all of the second.
        counts = F.transform(
            left,
            lambda a: _tally(
                _before(right, a, False).cast("bigint"), (F.size(right) - _before(right, a, True)).cast("bigint")
            ),
        )
        total = F.aggregate(counts, none, _add)
        return F.struct(F.sort_array(F.concat(left, right)).alias("run"), total.alias("pairs"))

    def round_(state, _):
        halves = F.sequence(F.lit(0), F.floor((F.size(state["runs"]) - 1) / 2).cast("int"))
        made = F.transform(halves, lambda k: merged(state["runs"], k))
        total = F.aggregate(made, state["pairs"], lambda t, m: _add(t, m["pairs"]))
        return F.struct(F.transform(made, lambda m: m["run"]).alias("runs"), total.alias("pairs"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(order))).cast("int"))
    single = F.transform(order, lambda item: F.array(item))
    start = F.struct(single.alias("runs"), none.alias("pairs"))
    return F.aggregate(rounds, start, round_, lambda state: _share_right(state["pairs"]))


def pairacc(ranking: Column, rates: Column) -> Column:
    """Share of unequal pairs that the ranking puts in the right order.

    A candidate the ranking leaves out counts as placed last; without an unequal pair
    the score is 1.
    """
    ranked = F.transform(ranking, lambda i: F.get(rates, i))
    # Those left out share one place, so none of their pairs is right: neither is one in
    # ascending order.
    left_out = F.filter(rates, lambda rate, i: ~F.array_contains(ranking, i))
    complete = (F.size(ranking) == F.size(rates)) & (F.array_max(ranking) < F.size(rates))
    in_order = F.when(complete, ranked).otherwise(
        F.array_compact(F.concat(ranked, F.sort_array(left_out)))
    )

    def share(order):
        return F.when(F.size(order) <= FEW, _share_of_few(order)).otherwise(_share_of_many(order))

    return _unless_missing(ranking, rates, let(in_order, share))


def reward(response: Column, ground_truth: Column, mode: str = "pairacc") -> Column:
    """Struct of score, ndcg, pairacc and top1_acc; all -1 when no ranking can be read."""
    rates = F.from_json(ground_truth, "array<double>")
    ids = named_candidates(response, F.size(rates))
    return F.struct(*with_failures(metrics(ids, rates), mode))


def metrics(ids: Column, rates: Column) -> Column:
    """Struct of ndcg, pairacc and top1_acc of the named candidates; null each unless all are named.

    Lists of usual length are scored by the batch; longer ones, and those with a rate that is
    null or no number, by the columns above.
    """

    def by_columns(row):
        return let(
            complete(row["ids"], F.size(row["rates"])),
            lambda ranking: F.struct(
                ndcg(ranking, row["rates"]).alias("ndcg"),
                pairacc(ranking, row["rates"]).alias("pairacc"),
                top1_acc(ranking, row["rates"]).alias("top1_acc"),
            ),
        )

    by_batch = short_metrics(ids, rates)
    row = F.struct(ids.alias("ids"), rates.alias("rates"))
    return F.when(by_batch.isNull(), let(row, by_columns)).otherwise(by_batch)


def with_failures(values: Column, mode: str = "pairacc") -> list[Column]:
    """The four scores from the struct of metrics: the mode's as `score`, -1 for nulls."""
    named = {name: F.coalesce(values[name], F.lit(FAILED)) for name in SCORES[1:]}
    first = named["ndcg" if mode == "ndcg" else "pairacc"]
    return [first.alias("score"), *[v.alias(name) for name, v in named.items()]]
