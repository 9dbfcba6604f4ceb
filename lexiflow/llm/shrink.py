"""Strength of a prior that groups of documents are shrunk towards, from moments."""

from __future__ import annotations

from math import sqrt

#: Strengths, in documents: where groups do not differ at all, and where nothing but the group matters.
MAX_STRENGTH, LEAST_STRENGTH = 10_000.0, 1.0
#: Groups count as alike if they differ by no more than so many standard errors of chance.
ERRORS = 3.0


def strength(documents: float, groups: float, squares: float, between: float, variance: float, inverse: float) -> float:
    """a + b of the beta prior of groups of values between 0 and 1.

    documents: values in all; groups: groups less those of the level above (1 for the whole); squares: sum of
    n * n / N over groups of n values in a level above of N; between: sum of n * (mean - mean above)**2;
    variance: of one value around the mean above; inverse: sum of 1 / n.

    Means of groups that do not differ still scatter, by variance / n each: that part is taken out of
    `between`, and out of what a true difference would add to it, before the two are compared. With nothing
    left, or where no group has two values, the strength is MAX_STRENGTH.
    """
    chance = variance * groups
    error = sqrt(2 * variance * variance * groups + variance * inverse)
    room = variance * (documents - squares - groups)
    if room <= 0 or between - chance <= ERRORS * error:
        return MAX_STRENGTH
    alike = min(1.0, (between - chance) / room)  # correlation of two values of one group
    return min(MAX_STRENGTH, max(LEAST_STRENGTH, 1 / alike - 1))
