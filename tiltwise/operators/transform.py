"""Feature transforms, fitted once and applied to the internal and the external side alike.

A transform is a list of terms, each a product of a column, perhaps squared or with a partner, and perhaps restricted to one
class of the outcome.  Applying it is one projection, so Catalyst prunes and pushes down as for any select, and a streaming
DataFrame can be transformed as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from .profile import profile


@dataclass(frozen=True)
class Term:
    """``name`` = product of ``factors`` (column, power) and of indicators of ``levels`` (column, value), times y or 1 - y by
    ``stratum``; "Y" itself has no factors."""

    name: str
    factors: tuple[tuple[str, int], ...]
    stratum: int | None = None
    levels: tuple[tuple[str, str], ...] = ()

    @property
    def variable(self) -> str:
        return "*".join(sorted({c for c, _ in self.factors} | {f"{c}{v}" for c, v in self.levels})) or self.name

    @property
    def power(self) -> int:
        return max((p for _, p in self.factors), default=1)


@dataclass(frozen=True)
class TransformSpec:
    terms: tuple[Term, ...]
    outcome: str
    codes: dict[str, dict[str, int]] = field(default_factory=dict)  # of string columns: value to code from 0
    whole_rows: bool = False  # leave out rows with a missing value, or with a level that was not there when this was fitted

    def value(self, name: str) -> Column:
        if name in self.codes:
            table = self.codes[name]
            found = F.lit(None).cast("double")
            for value, code in table.items():
                found = F.when(col(name) == value, F.lit(float(code))).otherwise(found)
            return found
        return col(name).cast("double")

    def expression(self, term: Term) -> Column:
        y = self.value(self.outcome)
        out = y if not term.factors and not term.levels else None
        for name, power in term.factors:
            x = self.value(name)
            x = x * x if power == 2 else x
            out = x if out is None else out * x
        for name, level in term.levels:
            x = F.when(col(name) == level, 1.0).otherwise(0.0)
            out = x if out is None else out * x
        if term.stratum is not None:
            out = out * (y if term.stratum == 1 else 1 - y)
        return out

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.terms]

    @property
    def complete(self) -> Column:
        """Whether a row has a value, of a known level, in every column that a term uses."""
        out = F.lit(True)
        for name in dict.fromkeys([self.outcome, *(c for t in self.terms for c, _ in (*t.factors, *t.levels))]):
            known = col(name).isin(*self.codes[name]) if name in self.codes else col(name).isNotNull() & ~F.isnan(col(name).cast("double"))
            out = out & F.coalesce(known, F.lit(False))
        return out

    def used(self, df: DataFrame) -> DataFrame:
        return df.where(self.complete) if self.whole_rows else df

    def apply(self, df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """The terms as columns, with the columns ``keep`` of ``df`` before them; only rows that are ``used``."""
        df = self.used(df)
        return df.select(*[col(c) for c in keep], *[self.expression(t).alias(t.name) for t in self.terms])

    def means(self, df: DataFrame, weight: Column | None = None) -> dict[str, float]:
        """Means of the terms over the rows of ``df`` that are used: all that an external site has to give.  One aggregate, one row."""
        df = self.used(df)
        w = weight if weight is not None else F.lit(1.0)
        row = df.agg(*[(F.sum(w * self.expression(t)) / F.sum(w)).alias(f"m{i}") for i, t in enumerate(self.terms)]).first()
        return {t.name: row[f"m{i}"] for i, t in enumerate(self.terms)}


def string_codes(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Codes from 0 in alphabetical order for string columns, which have few values (they are factors)."""
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return {}
    model = StringIndexer(inputCols=texts, outputCols=[f"{c}__code" for c in texts], stringOrderType="alphabetAsc", handleInvalid="skip").fit(df.select(*[col(c) for c in texts]))
    return {c: {v: i for i, v in enumerate(labels)} for c, labels in zip(texts, model.labelsArray, strict=True)}


KINDS = ("Table 1", "Interaction", "Interaction v0", "flat")


def fit_transform(
    df: DataFrame, kind: str = "Table 1", outcome: str = "Y", features: list[str] | None = None, outcome_balance: bool = True, interactions: list[str] | tuple[str, ...] = (), contrasts: bool = False
) -> TransformSpec:
    """Choose the terms from the data of one side; any other ``kind`` than those of ``KINDS`` is ``flat``.

    "Table 1": columns with more than two values also get a square; with ``outcome_balance`` there is ``Y``, then all
    terms for class 1, then all for class 0; without it, columns and squares as they are.  "flat": the same terms under the
    names of a model formula.  "Interaction": also the product of every column with each of ``interactions``, squares
    excepted, for both classes.  "Interaction v0": every Table 1 term, squares included, times each of ``interactions``.

    String columns are codes from 0, unless ``contrasts`` are asked for (of all kinds but "Table 1"): then they are indicators of
    levels, which are those of ``df`` and hold on the other side too.  As in a model formula, a term on its own has an
    indicator for each level, and a product one for each level but the first, as the term without it is there; factors have no
    squares.  Rows with a missing value, or a level that ``df`` has not, are then left out.
    """
    if contrasts and kind == "Table 1":
        raise ValueError("Table 1 has codes for strings, not contrasts")
    features = [c for c in (features or df.columns) if c != outcome]
    codes = string_codes(df, [*features, outcome])
    numeric = profile(df, [c for c in features if c not in codes])
    squared = [c for c in features if (len(codes[c]) > 2 and not contrasts if c in codes else numeric[c].arity > 2)]
    single = [(c, ((c, 1),)) for c in features]
    squares = [(f"({c}^2)", ((c, 2),)) for c in squared]
    if kind == "Table 1":
        if not outcome_balance:
            return TransformSpec((*(Term(n, f) for n, f in single + squares), Term(outcome, ())), outcome, codes)
        both = [Term(f"{n}:y{y}", f, y) for y in (1, 0) for n, f in single + squares]
        return TransformSpec((Term("Y", ()), *both), outcome, codes)
    squares = [(f"I({c}^2)", ((c, 2),)) for c in squared]
    strata = ((1, f"I({outcome})"), (0, f"I(1 - {outcome})"))
    terms = [Term(outcome, ())] + [Term(f"{label}:{n}", f, y) for y, label in strata for n, f in single + squares]
    seen = {(frozenset(t.factors), t.stratum) for t in terms}
    if kind in ("Interaction", "Interaction v0"):
        for y, label in strata:
            for v in interactions:
                for n, f in single + (squares if kind == "Interaction v0" else []):
                    if any(c == v for c, _ in f) and (kind == "Interaction" or f == ((v, 1),)):
                        continue  # a column with itself is itself
                    factors = (*f, (v, 1))
                    if (key := (frozenset(factors), y)) not in seen:
                        seen.add(key)
                        terms.append(Term(f"{label}:{n}:{v}", factors, y))
            if kind == "Interaction v0":
                continue
    if contrasts:
        levels = {c: list(v) for c, v in codes.items() if c != outcome}
        return TransformSpec(tuple(t for term in terms for t in _by_levels(term, levels, outcome)), outcome, codes, True)
    return TransformSpec(tuple(terms), outcome, codes)


def _by_levels(term: Term, levels: dict[str, list[str]], outcome: str) -> list[Term]:
    """A term with factor columns as a term for each combination of their levels."""
    if not any(c in levels for c, _ in term.factors):
        return [term]
    label = {1: f"I({outcome})", 0: f"I(1 - {outcome})"}[term.stratum]
    alone = len(term.factors) == 1
    found: list[tuple[tuple, tuple, tuple[str, ...]]] = [((), (), ())]
    for c, power in term.factors:
        if c in levels:
            own = levels[c] if alone else levels[c][1:]
            found = [(f, (*v, (c, level)), (*n, f"{c}{level}")) for f, v, n in found for level in own]
        else:
            found = [((*f, (c, power)), v, (*n, f"I({c}^2)" if power == 2 else c)) for f, v, n in found]
    return [Term(":".join((label, *n)), f, term.stratum, v) for f, v, n in found]


def normalise(z: DataFrame, mu: dict[str, float], min_sd: float = 1e-4, columns: list[str] | None = None, count: str | None = None) -> tuple[DataFrame, dict[str, float], dict[str, tuple[float, float]]]:
    """Columns whose sample deviation is above ``min_sd``, centred and scaled; means likewise; and (mean, sd) of each.

    ``count`` says for how many rows a row stands.
    """
    found = profile(z, columns, count)
    kept = {c: (p.mean, p.sd) for c, p in found.items() if p.sd is not None and p.sd > min_sd}
    scaled = z.select(*[((col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in kept.items()])
    return scaled, {c: (mu[c] - m) / s for c, (m, s) in kept.items() if c in mu}, kept
