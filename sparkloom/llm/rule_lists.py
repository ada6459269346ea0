"""Ordered rule lists by incremental reduced-error pruning, and their form as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TRIES = 8


@dataclass
class Rule:
    """A conjunction of (feature, ``>`` or ``<=``, threshold)."""

    label: str
    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.ones(n, bool)
        for name, sign, at in self.tests:
            out &= x[name] > at if sign == ">" else x[name] <= at
        return out

    def sql(self) -> str:
        return " AND ".join(f"{name} {sign} {at!r}" for name, sign, at in self.tests) or "TRUE"


def _grow(x: dict[str, np.ndarray], y: np.ndarray, label: str, cuts: int) -> Rule:
    rule, inside = Rule(label), np.ones(len(y), bool)
    while len(rule.tests) < 6:
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        if not n0 or not p0:
            break
        best, test = 0.0, None
        for name, values in x.items():
            there = np.unique(values[inside])
            middle = (there[1:] + there[:-1]) / 2
            for at in middle if len(middle) <= cuts else np.quantile(middle, np.linspace(0, 1, cuts)):
                for sign, chosen in ((">", inside & (values > at)), ("<=", inside & (values <= at))):
                    p, n = (chosen & y).sum(), (chosen & ~y).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best + 1e-9:
                            best, test = gain, (name, sign, float(round(at, 4)))
        if test is None:
            break
        rule.tests.append(test)
        inside = rule.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        inside = r.holds(x)
        p, n = (inside & y).sum(), (inside & ~y).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.tests) - 1, 0, -1):
        shorter = Rule(rule.label, rule.tests[:k])
        if worth(shorter) >= worth(best):
            best = shorter
    return best


def learn(x: dict[str, np.ndarray], labels: np.ndarray, order: list[str], seed: int = 7, cuts: int = 48) -> list[Rule]:
    """Rules for the classes of ``order`` in that order; what no rule takes belongs to none of them.

    Two thirds of the rows grow a rule, the rest prunes it; a class is done when ``TRIES`` partitions of the rows in succession
    give rules that err more often than one time in four.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(labels), bool)
    for label in order:
        failed = 0
        while failed < TRIES and (labels[left] == label).any():
            at = np.flatnonzero(left)
            rng.shuffle(at)
            grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
            take = lambda rows: ({k: v[rows] for k, v in x.items()}, labels[rows] == label)  # noqa: E731, B023
            rule = _prune(_grow(*take(grow), label, cuts), *take(prune))
            px, py = take(prune)
            inside = rule.holds(px)
            if not rule.tests or (inside & ~py).sum() * 4 >= max(1, inside.sum()):
                failed += 1
                continue
            failed = 0
            rules.append(rule)
            left &= ~rule.holds(x)
    return rules


def to_sql(rules: list[Rule], otherwise: str) -> str:
    """The list as a CASE expression."""
    if not rules:
        return f"'{otherwise}'"
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.label}'" for r in rules) + f" ELSE '{otherwise}' END"
