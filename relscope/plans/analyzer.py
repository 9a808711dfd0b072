"""Analysis of a whole table: relationships, profiles of columns, combinations, super- and subcategories, bins.

The driver holds names and outcomes, one per pair of columns; rows never reach it.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import roles
from ..operators import assumptions, binning, chi2, descriptive, numeric, preparation
from . import compare, lattice

OUTCOMES = ("significant", "not_significant", "assumptions_not_met")


@dataclass
class TargetProfile:
    """What is known of a column: features by outcome with their tests, its distribution, combinations, bins."""

    kind: str
    features: dict[str, dict[str, str]] = field(default_factory=lambda: {o: {} for o in OUTCOMES})
    distribution: str | None = None
    combinations: dict[str, dict[tuple[str, ...], str]] = field(default_factory=lambda: {o: {} for o in OUTCOMES})
    longest_combination: int = 1
    supercategories: list[str] = field(default_factory=list)
    subcategories: list[str] = field(default_factory=list)
    min_bins: int | None = None
    min_bins_by_feature: dict[str, int] = field(default_factory=dict)


@dataclass
class Analyzer:
    """Configured once, fitted in stages; every ``fit`` returns the analyzer."""

    numnum: object = True
    numcat: object = True
    catcat: object = True
    uniform: object = True
    normal: object = True
    check_assumptions: bool = False
    anova_rules: assumptions.AnovaRules = assumptions.AnovaRules(0.02, 0.02, 5, 3)
    kruskal_rules: assumptions.KruskalRules = assumptions.KruskalRules(0.01, 0.01, True, 0.7, True)
    dropna: bool = True
    delimiter: str = preparation.DELIMITER
    max_combinations: int = 50_000
    compat: bool = False
    pairs: dict[str, dict[str, dict[tuple[str, str], str]]] = field(default_factory=lambda: {f: {o: {} for o in OUTCOMES} for f in compare.FAMILIES})
    profiles: dict[str, TargetProfile] = field(default_factory=dict)
    super_sub: list[tuple[str, str]] = field(default_factory=list)
    not_super_sub: list[tuple[str, str]] = field(default_factory=list)
    fitted: set[str] = field(default_factory=set)
    kinds: dict[str, str] = field(default_factory=dict)
    uniform_fit: dict[str, bool] = field(default_factory=dict)
    normal_fit: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self):
        self.tests = {f: compare.instructions(getattr(self, f), f) for f in (*compare.FAMILIES, "uniform", "normal")}

    # Profiles.

    def profile(self, column: str, kind: str) -> TargetProfile:
        return self.profiles.setdefault(column, TargetProfile(kind))

    def _kinds(self, df: DataFrame, numeric_columns, categoric_columns, numeric_target, categoric_target) -> dict[str, str]:
        nums = roles.numeric_columns(df, numeric_columns, numeric_target)
        cats = roles.categoric_columns(df, categoric_columns, categoric_target)
        return {c: "numeric" for c in nums} | {c: "categoric" for c in cats}

    def _record(self, found: list, kinds: dict[str, str], targets: list[str]) -> None:
        for r in found:
            a, b = r["column_a"], r["column_b"]
            family = {2: "numnum", 1: "numcat", 0: "catcat"}[sum(kinds[c] == "numeric" for c in (a, b))]
            key = (a, b) if family == "numcat" else tuple(sorted((a, b)))
            for o in OUTCOMES:
                self.pairs[family][o].pop(key, None)
            self.pairs[family][r["outcome"]][key] = r["label"]
            for own, other in ((a, b), (b, a)):
                if not targets or own in targets:
                    p = self.profile(own, kinds[own])
                    for o in OUTCOMES:
                        p.features[o].pop(other, None)
                    p.features[r["outcome"]][other] = r["label"]

    # Stages.

    def fit_column_relationships(self, df: DataFrame, numeric_columns: roles.Names = None, categoric_columns: roles.Names = None, numeric_target: roles.Names = None, categoric_target: roles.Names = None, exclude: roles.Names = None) -> Analyzer:
        """All pairs by all tests, classified; the results are one row per pair and test."""
        pool = (numeric_columns, categoric_columns, numeric_target, categoric_target)
        results = compare.measured(df, self.tests, *pool, exclude, self.check_assumptions, self.anova_rules, self.kruskal_rules, self.dropna)
        kinds = self._kinds(df, *pool)
        self._record(compare.classified(results, self.tests, self.compat).collect(), kinds, roles.names(numeric_target) + roles.names(categoric_target))
        self.kinds |= kinds
        self.fitted |= set(kinds)
        return self

    def fit_goodness_of_fit_uniform(self, df: DataFrame, columns: roles.Names = None) -> Analyzer:
        if not self.tests["uniform"]:
            warnings.warn("goodness of fit is disabled", stacklevel=2)
            return self
        names = roles.names(columns) or [c for c in roles.categoric_columns(df) if c not in self.uniform_fit]
        if names:
            _, alpha, _ = self.tests["uniform"][0]
            for r in chi2.goodness_of_fit(df, names, dropna=self.dropna).collect():
                differs = r["p_value"] is not None and r["p_value"] < alpha
                met = r["assumptions_met"] or not self.check_assumptions
                self.uniform_fit[r["category"]] = differs
                self.profile(r["category"], "categoric").distribution = "assumptions_not_met" if not met else "not_uniform" if differs else "uniform"
        return self

    def fit_normal(self, df: DataFrame, columns: roles.Names = None) -> Analyzer:
        if not self.tests["normal"]:
            warnings.warn("normality is disabled", stacklevel=2)
            return self
        names = roles.names(columns) or [c for c in roles.numeric_columns(df) if c not in self.normal_fit]
        if names:
            _, alpha, _ = self.tests["normal"][0]
            for r in numeric.normality(df, names).collect():
                differs = r["p_value"] is not None and r["p_value"] < alpha
                self.normal_fit[r["numeric"]] = differs
                self.profile(r["numeric"], "numeric").distribution = "not_normal" if differs else "normal"
        return self

    def fit_multivariate(self, df: DataFrame, targets: roles.Names, max_size: int = 3, min_size: int = 2) -> Analyzer:
        """Combinations of categories that aren't significant alone, size by size, all of a size rolled up from one grouping.

        A size with more than ``max_combinations`` ends the search; members of significant
        combinations leave the pool after their size.
        """
        for target in roles.names(targets):
            p = self.profiles.get(target)
            if p is None:
                continue
            pool = sorted(c for c in p.features["not_significant"] if self.kinds.get(c) == "categoric")
            for size in range(min_size, max_size + 1):
                if size > len(pool):
                    break
                if math.comb(len(pool), size) > self.max_combinations:
                    warnings.warn(f"{target}: more than {self.max_combinations} combinations of {size}", stacklevel=2)
                    break
                combos = {preparation.HEADER.join(c): c for c in combinations(pool, size)}
                tests = self.tests["numcat" if p.kind == "numeric" else "catcat"]
                results = lattice.measured(df, target, p.kind == "numeric", pool, list(combos.values()), tests, self.delimiter, self.check_assumptions, self.anova_rules, self.kruskal_rules)
                for r in compare.classified(results, self.tests, self.compat).collect():
                    other = r["column_b"] if r["column_a"] == target else r["column_a"]
                    p.combinations[r["outcome"]][combos[other]] = r["label"]
                p.longest_combination = size
                used = {c for combo in p.combinations["significant"] for c in combo}
                pool = [c for c in pool if c not in used]
        return self

    def fit_super_sub(self, df: DataFrame, max_bits: float = 0.2, pairs: list[tuple[str, str]] | None = None, isolate: bool = False) -> Analyzer:
        """Pairs of categories where one (nearly) follows from the other; both directions in one job."""
        if pairs is None:
            pairs = list(self.pairs["catcat"]["significant"]) or roles.same_pairs(roles.categoric_columns(df))
        both = [q for p in pairs for q in (tuple(p), tuple(p)[::-1])]
        if not both:
            return self
        bits = {(r["supercategory"], r["subcategory"]): r["bits"] for r in chi2.conditional_entropy(df, both).collect()}
        for a, b in pairs:
            found = next((q for q in ((a, b), (b, a)) if bits.get(q) is not None and bits[q] <= max_bits), None)
            if not found:
                self.not_super_sub.append((a, b))
                continue
            if found not in self.super_sub:
                self.super_sub.append(found)
            high, low = found
            self.profile(high, "categoric").subcategories.append(low)
            self.profile(low, "categoric").supercategories.append(high)
            if isolate:
                self.pairs["catcat"]["significant"].pop(tuple(sorted(found)), None)
                for own, other in ((high, low), (low, high)):
                    self.profiles[own].features["significant"].pop(other, None)
        return self

    def fit_full_dataset_analysis(self, df: DataFrame, numeric_columns: roles.Names = None, categoric_columns: roles.Names = None, numeric_target: roles.Names = None, categoric_target: roles.Names = None, good_of_fit: bool = True, normal: bool = True, multivariates: bool = False, super_sub: bool = False) -> Analyzer:
        """All stages.  With targets of one kind only, the other kind's distribution isn't tested."""
        nums, cats = roles.names(numeric_target), roles.names(categoric_target)
        self.fit_column_relationships(df, numeric_columns, categoric_columns, nums, cats)
        kinds = self._kinds(df, numeric_columns, categoric_columns, nums, cats)
        if good_of_fit and not (nums and not cats):
            self.fit_goodness_of_fit_uniform(df, cats or [c for c, k in kinds.items() if k == "categoric"])
        if normal and not (cats and not nums):
            self.fit_normal(df, nums or [c for c, k in kinds.items() if k == "numeric"])
        if multivariates:
            self.fit_multivariate(df, [*nums, *cats] or list(kinds))
        if super_sub:
            self.fit_super_sub(df)
        return self

    # Bins.

    def binning_metrics(self, df: DataFrame, target: str, multivariate: bool = False, distinct_threshold: int = 5) -> tuple[int | None, dict[str, int | None]]:
        """(fewest bins, by feature) of a numeric target against the features of its profile, and combinations if asked for."""
        p = self.profiles.get(target)
        if p is None or p.kind != "numeric" or df.agg(F.count_distinct(F.col(f"`{target}`"))).first()[0] <= distinct_threshold:
            return None, {}
        features = p.features["significant"]
        kinds = {c: self.kinds[c] for c in features}
        by: dict[str, int | None] = {}
        combos = {preparation.HEADER.join(c): c for c in p.combinations["significant"]} if multivariate else {}
        for name, c in combos.items():
            df = preparation.concatenated(df, list(c), self.delimiter, name)
        for family, kind in (("numnum", "numeric"), ("numcat", "categoric")):
            pairs = [(target, c) for c in features if kinds[c] == kind] + ([(target, c) for c in combos] if kind == "categoric" else [])
            for method, threshold, above in self.tests[family] if pairs else []:
                found = binning.find_minimums(df, pairs, method, threshold, bool(above))
                for x, s in found[target].by_feature.items():
                    by[x] = max((n for n in (by.get(x), s.found) if n is not None), default=None)
        return max((n for n in by.values() if n is not None), default=None), by

    def fit_binning_thresholds(self, df: DataFrame, targets: roles.Names = None, multivariate: bool = False, distinct_threshold: int = 5) -> Analyzer:
        """Metrics of numeric targets, merged with earlier ones by the larger."""
        for target in roles.names(targets) or [c for c, p in self.profiles.items() if p.kind == "numeric"]:
            least, by = self.binning_metrics(df, target, multivariate, distinct_threshold)
            p = self.profiles.get(target)
            if p and least is not None:
                p.min_bins = max(p.min_bins or 0, least)
                p.min_bins_by_feature |= {x: max(n, p.min_bins_by_feature.get(x, 0)) for x, n in by.items() if n is not None}
        return self

    # Reports.

    def relationships(self, df: DataFrame, targets: roles.Names = None) -> DataFrame:
        """(target, type, distribution, longest_combination, features, tests): one row per target and feature or combination."""
        rows = []
        for t in roles.names(targets) or list(self.profiles):
            p = self.profiles.get(t)
            if p:
                found = [([c], label) for c, label in p.features["significant"].items()] + [(list(c), label) for c, label in p.combinations["significant"].items()]
                rows += [(t, p.kind, p.distribution, p.longest_combination, c, label) for c, label in found]
        return df.sparkSession.createDataFrame(rows, "target string, type string, distribution string, longest_combination int, features array<string>, tests string")

    def plot_data(self, df: DataFrame, targets: roles.Names, auto_fit: bool = True, multivariates: bool = False, plot: str = "boxen") -> dict[tuple[str, ...], dict[str, DataFrame]]:
        """The data of every plot of :meth:`target_plots`, by family and columns, as frames that follow levels and grids and not the rows.

        Numbers have ``histogram`` and ``density``, categories ``counts``; pairs of numbers what a joint plot draws, numbers over
        categories quartiles (``box``), ``letter_values`` (``boxen``) or ``density`` (``violin``), pairs of categories a
        ``contingency`` table, super- and subcategories their ``makeup``.  With ``multivariates`` significant
        combinations come as one category each.
        """
        if plot not in ("box", "boxen", "violin"):
            raise ValueError("plot must be box, boxen or violin")
        over = {
            "box": lambda d, c, y: {"quartiles": descriptive.distribution_per_category(d, c, y, (0.0, 0.25, 0.5, 0.75, 1.0))},
            "boxen": lambda d, c, y: {"letter_values": descriptive.letter_values(d, c, y)},
            "violin": lambda d, c, y: {"density": descriptive.density(d, y, c)},
        }[plot]
        out: dict[tuple[str, ...], dict[str, DataFrame]] = {}
        listed = self.target_plots(df, targets, auto_fit)
        for y in listed["numeric"]:
            out["numeric", y] = {"histogram": descriptive.histogram(df, y), "density": descriptive.density(df, y, grid=200, cut=0.0)}
        for c in listed["categoric"]:
            out["categoric", c] = {"counts": descriptive.value_counts(df, [c])}
        for a, b in listed["numnum"]:
            out["numnum", a, b] = descriptive.joint(df, a, b)
        for a, b in listed["numcat"]:
            out["numcat", a, b] = over(df, b, a)
        for a, b in listed["catcat"]:
            out["catcat", a, b] = {"contingency": descriptive.contingency(df, a, b)}
        for a, b in listed["super_sub"]:
            out["super_sub", a, b] = {"makeup": descriptive.column_makeup(df, a, b)}
        for t in roles.names(targets) if multivariates else []:
            p = self.profiles[t]
            for members in p.combinations["significant"]:
                wide = preparation.concatenated(df, list(members), self.delimiter, "_combination")
                frames = over(wide, "_combination", t) if p.kind == "numeric" else {"contingency": descriptive.contingency(wide, t, "_combination")}
                out["combination", t, *members] = frames
        return out

    def target_plots(self, df: DataFrame, targets: roles.Names, auto_fit: bool = True) -> dict[str, list]:
        """What to draw for targets: univariate columns and pairs by family, each once; fits what is missing.

        A stage that is disabled is left out with a warning; without ``auto_fit`` a missing
        one raises.
        """
        missing = [t for t in roles.names(targets) if t not in self.fitted]
        if missing and not auto_fit:
            raise RuntimeError(f"not fitted: {missing}")
        nums, cats = roles.numeric_columns(df), roles.categoric_columns(df)
        if missing:
            self.fit_column_relationships(df, None, None, [t for t in missing if t in nums], [t for t in missing if t in cats])
        out: dict[str, list] = {"numeric": [], "categoric": [], **{f: [] for f in compare.FAMILIES}, "super_sub": []}
        for t in roles.names(targets):
            kind = "numeric" if t in nums else "categoric"
            known = self.normal_fit if kind == "numeric" else self.uniform_fit
            if t not in known and auto_fit:
                (self.fit_normal if kind == "numeric" else self.fit_goodness_of_fit_uniform)(df, t)
            if known.get(t):
                out[kind].append(t)
            for f in compare.FAMILIES:
                out[f] += [p for p in self.pairs[f]["significant"] if t in p and p not in out[f]]
            out["super_sub"] += [p for p in self.super_sub if t in p and p not in out["super_sub"]]
        return out
