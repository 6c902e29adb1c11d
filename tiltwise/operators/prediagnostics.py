"""Can the internal rows be weighted to the external means at all?  Rules over column profiles.

Two profiles are taken, each of two aggregates: of all rows, and of the rows that remain after degenerate strata are left
out (the second only if there are such).  Everything else is arithmetic on one row per feature.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .profile import ColumnProfile, profile

log = logging.getLogger(__name__)

#: Names of the log's fields, in their order and spelling.
FIELDS = (
    "preDiagnosisStatus", "missingInMu", "missingInZ", "nOverlapFeatures", "naInZ", "naInMu",
    "highlySkewedBinary", "highSkewRepresentative", "incompatableUnaryVariable", "incompatibleUnaryRepresentative",
    "outOfRange", "outOfRangeRepresentative", "fewSamples", "fewSamplesDescription",
)
#: Bound on the variance proxy of a binary feature for more than LARGE rows; 2 / n below.
PROXY_BOUND, LARGE = 0.000625, 2000
SKEW_MAX_DIFF, MIN_REPORT = 0.01, 20


def number(x: float, digits: int = 15) -> str:
    """A number as short as it can be written with so many significant digits."""
    return f"{x:.{digits}g}"


@dataclass
class PreDiagnosis:
    status: str = "Success"
    log: dict[str, object] = field(default_factory=lambda: dict.fromkeys(FIELDS))
    keep: Column | None = None  # rows that remain; None for all
    n_rows: int = 0
    represented: list[str] = field(default_factory=list)
    highly_skewed: list[str] = field(default_factory=list)
    nearly_unary: list[str] = field(default_factory=list)
    unary: list[str] = field(default_factory=list)
    out_of_range: list[str] = field(default_factory=list)

    def fail(self) -> None:
        self.status = self.log["preDiagnosisStatus"] = "Failure"

    def frame(self, spark) -> DataFrame:
        """``field, value_num, value_str``: flags and counts as numbers, texts as strings."""
        rows = []
        for i, (k, v) in enumerate(self.log.items()):
            rows.append((i, k, None, v) if isinstance(v, str) or v is None else (i, k, float(v), None))
        return spark.createDataFrame(rows, "position int, field string, value_num double, value_str string")


def variance_proxy(n: float, n1: float, mean: float) -> float:
    """How much a mean estimated after weighting both values of a binary feature would vary; infinite if one is missing."""
    n0 = n - n1
    return (math.inf if n0 == 0 else (1 - mean) ** 2 / n0) + (math.inf if n1 == 0 else mean**2 / n1)


def overlap(names: list[str], mu: dict[str, float]) -> tuple[list[str], list[str], int]:
    """Names in z but not in mu, in mu but not in z, and the number in both."""
    inside = set(names)
    return [c for c in names if c not in mu], [c for c in mu if c not in inside], sum(c in inside for c in mu)


def degenerate(found: dict[str, ColumnProfile], mu: dict[str, float]) -> dict[str, float]:
    """Binary features of which the external data has one value only, with that value."""
    return {c: mu[c] for c, p in found.items() if p.arity == 2 and not p.missing and mu[c] in (p.low, p.high)}


def binary_skew(p: ColumnProfile, mu: float, max_subset: int) -> tuple[bool, float | None, int]:
    """Whether a binary feature is too imbalanced for its mean, with the proxy (None if constant) and the count of its upper value."""
    if p.high > p.low:
        share = min(max_subset / p.count, 1)
        proxy = variance_proxy(p.count, p.at_high * share, (mu - p.low) / (p.high - p.low))
        return proxy > (PROXY_BOUND if p.count > LARGE else 2 / p.count), proxy, p.at_high
    return abs(mu - p.low) > SKEW_MAX_DIFF, None, 0 if p.low == 0 else p.count


def pre_diagnostics(z: DataFrame, mu: dict[str, float], max_diff: float = 0.01, np_min_ratio: float = 4, max_subset: int = 20000, features: list[str] | None = None) -> PreDiagnosis:
    """Check names, missing values, binary, unary and numeric features and the number of rows, in this order.

    Names or values that are missing end the checks with ``Failure``; the others are all made.  Features without variation
    in the external data restrict the rows instead of being matched.
    """
    out = PreDiagnosis()
    names = list(features or z.columns)
    not_in_mu, not_in_z, both = overlap(names, mu)
    out.log |= {"preDiagnosisStatus": "Success", "missingInMu": bool(not_in_mu), "missingInZ": bool(not_in_z), "nOverlapFeatures": both}
    for c in not_in_mu:
        log.warning("%s is in z but not in mu", c)
    for c in not_in_z:
        log.warning("%s is in mu but not in z", c)
    if not_in_mu or not_in_z or not both:
        out.fail()
        return out
    if both == 1:
        log.warning("z and mu have one feature in common")
    everything = profile(z, names)
    out.log["naInZ"] = any(p.missing for p in everything.values())
    if out.log["naInZ"]:
        out.fail()
        return out
    out.log["naInMu"] = any(mu[c] is None or math.isnan(mu[c]) for c in names)
    if out.log["naInMu"]:
        out.fail()
        return out

    fixed = degenerate(everything, mu)
    inside = everything
    out.n_rows = next(iter(everything.values())).count
    if fixed:
        out.keep = reduce(lambda a, b: a & b, [col(c) == F.lit(v) for c, v in fixed.items()])
        inside = profile(z.where(out.keep), names)
        out.n_rows = next(iter(inside.values())).count
    binary = [c for c in names if everything[c].arity == 2 and c not in fixed]
    skewed: list[tuple[float, str]] = []
    for c in binary if out.n_rows else []:
        p = inside[c]
        bad, proxy, n1 = binary_skew(p, mu[c], max_subset)
        if bad:
            few = n1 <= MIN_REPORT  # small counts are not told
            shown = f"n1<={MIN_REPORT} mean<={number(MIN_REPORT / p.count)}" if few else f"n1={n1} mean={number(p.mean, 3)}"
            nearly = mu[c] < SKEW_MAX_DIFF
            (out.nearly_unary if nearly else out.highly_skewed).append(c)
            skewed.append((proxy or 0.0, f"{'Nearly-unary' if nearly else 'Skewed'} {c}: n={p.count} {shown} mu={number(mu[c], 3)}"))
    out.log["highlySkewedBinary"] = bool(out.highly_skewed)
    out.log["highSkewRepresentative"] = max(skewed, key=lambda s: s[0])[1] if skewed else None
    if out.highly_skewed:
        out.fail()

    dropped = {*fixed, *out.nearly_unary}
    out.unary = [c for c in names if everything[c].arity == 1 and c not in dropped]
    worst = max(out.unary, key=lambda c: abs(everything[c].mean - mu[c]), default=None)
    out.log["incompatableUnaryVariable"] = worst is not None and abs(everything[worst].mean - mu[worst]) > max_diff
    if out.log["incompatableUnaryVariable"]:
        out.log["incompatibleUnaryRepresentative"] = f"{worst}: mean z={number(everything[worst].mean)}, mu={number(mu[worst])}"
        out.fail()

    out.represented = [c for c in names if c not in dropped and c not in out.unary]
    for c in out.represented if out.n_rows else []:
        p = inside[c]
        if not p.low - max_diff <= mu[c] <= p.high + max_diff:
            if not out.out_of_range:
                out.log["outOfRangeRepresentative"] = f"{c}, mu={number(mu[c])}, min={number(p.low)}, max={number(p.high)}"
            out.out_of_range.append(c)
    out.log["outOfRange"] = bool(out.out_of_range)
    if out.out_of_range:
        out.fail()

    ratio = out.n_rows / len(out.represented) if out.represented else math.inf if out.n_rows else 0.0
    out.log["fewSamples"] = ratio < np_min_ratio
    if out.log["fewSamples"]:
        out.log["fewSamplesDescription"] = f"Few samples n={out.n_rows}, p={len(out.represented)}"
        out.fail()
    return out
