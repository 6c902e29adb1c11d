"""Weights under which internal means equal external ones.

Every optimizer has ``optimize(z, mu, counts=None)`` on numpy arrays: ``z`` n x m, ``counts`` how many rows each row of z
stands for (weights depend on the row's values alone, so equal rows are solved as one).  It returns a WeightResult whose
weights have a mean of 1 over the rows counted.  Arrays of a sample capped by the settings fit in one task; for whole
tables see ``distributed.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np


@dataclass
class WeightResult:
    weights: np.ndarray
    status: str
    err: float | None = None
    max_abs_err: float | None = None
    iterations: int | None = None
    log: list[tuple] = field(default_factory=list)
    nu: np.ndarray | None = None


class WeightOptimizer(Protocol):
    def optimize(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray | None = None) -> WeightResult: ...


def standardise(z: np.ndarray, mu: np.ndarray, counts: np.ndarray, min_sd: float) -> tuple[np.ndarray, np.ndarray]:
    """z-scores by the sample deviation, without columns whose deviation is not above ``min_sd``."""
    n = counts.sum()
    mean = counts @ z / n
    sd = np.sqrt(np.maximum(counts @ (z - mean) ** 2, 0) / max(n - 1, 1))
    kept = sd > min_sd
    return (z[:, kept] - mean[kept]) / sd[kept], (mu[kept] - mean[kept]) / sd[kept]


def kl_to_uniform(w: np.ndarray, counts: np.ndarray) -> float:
    """log n + sum of w log w over rows; ``w`` are sums over the rows counted, adding up to 1."""
    inside = w > 0
    return float(np.log(counts.sum()) + (w[inside] * np.log(w[inside] / counts[inside])).sum())


class Tilt:
    """Weights ``base * exp(-z theta)`` scaled to add up to 1, kept as logs: whatever a solver does, theta is its whole state.

    Solvers see ``state``, ``reach`` and ``mu`` alone, so they run as they are on a table of any size (``distributed.TableTilt``).
    """

    WIDEST = 690.0  # exp of less than -WIDEST is no longer a normal number

    def __init__(self, z: np.ndarray, mu: np.ndarray, base: np.ndarray, counts: np.ndarray | None = None):
        self.z, self.mu, self.counts = z, mu, base if counts is None else counts
        self.width = np.ptp(z, axis=0) if len(z) else np.zeros(len(mu))
        with np.errstate(divide="ignore"):
            self.log_base = np.log(base / base.sum())

    def at(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares, how far their means are above ``mu``, and the log of the scale that is divided out."""
        score = self.log_base - self.z @ theta
        top = float(score.max())
        shares = np.exp(np.where(np.isneginf(score), score, np.maximum(score - top, -self.WIDEST)))
        total = shares.sum()
        shares = shares / total
        return shares, shares @ self.z - self.mu, top + float(np.log(total))

    def state(self, theta: np.ndarray) -> tuple[np.ndarray, float, float]:
        """How far the means are above ``mu``, the divergence from uniform weights, and the log of the scale."""
        shares, gap, scale = self.at(theta)
        return gap, kl_to_uniform(shares, self.counts), scale

    def states(self, thetas: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
        """The states at several thetas, a row each; a table takes them all in one pass."""
        return [self.state(theta) for theta in thetas]

    def batches(self, size: int, seed: int) -> Callable[[int, np.ndarray], np.ndarray]:
        """How far the means of the i-th sample of rows are above ``mu``, as a function of i and theta."""
        rng, shares = np.random.default_rng(seed), np.exp(self.log_base)

        def gap(i: int, theta: np.ndarray) -> np.ndarray:
            drawn = rng.multinomial(size, shares)
            taken = drawn > 0
            return Tilt(self.z[taken], self.mu, drawn[taken].astype(float)).at(theta)[1]

        return gap

    def reach(self, step: np.ndarray) -> float:
        """A bound on how far the logs of two weights may come apart if theta moves by ``step``."""
        return float(np.abs(step) @ self.width)


@dataclass
class Descent:
    """Where a solver ended: theta and the log of (error, divergence, largest absolute error) of every state it saw."""

    theta: np.ndarray
    status: str
    log: list[tuple]
    iterations: int

    @property
    def err(self) -> float:
        return float("inf") if self.status in ("NA-objective", "Failure") else self.log[-1][0]

    @property
    def worst(self) -> float | None:
        return None if self.status in ("NA-objective", "Failure") else self.log[-1][2]

    def result(self, weights: np.ndarray) -> WeightResult:
        return WeightResult(weights, self.status, self.err, self.worst, self.iterations, self.log)


#: A solver as a dialogue: it asks for the states at some thetas (a row each), is sent them, and returns where it ended.
Dialogue = Generator[np.ndarray, list[tuple[np.ndarray, float, float]], Descent]


def answer(dialogue: Dialogue, tilt: Tilt) -> Descent:
    asked = next(dialogue)
    while True:
        try:
            asked = dialogue.send(tilt.states(asked))
        except StopIteration as end:
            return end.value


def answer_all(dialogues: list[Dialogue], states: Callable[[np.ndarray, list[int]], list]) -> list[Descent]:
    """Lead several dialogues at once: ``states`` gets what all of them ask for and whose question each row is."""
    ended: list[Descent | None] = [None] * len(dialogues)
    asked = {i: next(d) for i, d in enumerate(dialogues)}
    while asked:
        whose = [i for i, thetas in asked.items() for _ in thetas]
        found = states(np.vstack(list(asked.values())), whose)
        following, at = {}, 0
        for i, thetas in asked.items():
            try:
                following[i] = dialogues[i].send(found[at : at + len(thetas)])
            except StopIteration as end:
                ended[i] = end.value
            at += len(thetas)
        asked = following
    return ended


@dataclass(frozen=True)
class ExponentiatedGradient:
    """Exponentiated gradient on the squared error of the means, as heavy-ball steps of the tilt at one learning rate.

    A rate is given up (``NA-objective``) when one step could spread the weights over more than doubles can hold.
    """

    alpha: float = 0.1
    n_iter: int = 1000
    abs_tol: float = 1e-9
    momentum: float = 0.9
    max_abs_tol: float = 1e-5
    max_success_mse: float = 0.1
    outcome_column: int | None = None  # start from weights that match the outcome's mean, if its column is not rescaled
    w0: np.ndarray | None = None

    def start(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray) -> np.ndarray:
        base = counts if self.w0 is None else counts * self.w0
        if self.outcome_column is None:
            return base
        case, share = z[:, self.outcome_column] == 1, mu[self.outcome_column]
        sizes = base[case].sum(), base[~case].sum()
        return base * np.where(case, share / sizes[0], (1 - share) / sizes[1]) if min(sizes) > 0 else base

    def converged(self, err: float, worst: float) -> bool:
        return err < self.abs_tol or worst < self.max_abs_tol

    def ask(self, theta: np.ndarray, reach: Callable[[np.ndarray], float]) -> Dialogue:
        velocity, log = np.zeros(len(theta)), []
        while True:
            ((gap, kl, _),) = yield theta[None, :]
            log.append((float(gap @ gap), kl, float(np.abs(gap).max(initial=0.0))))
            if self.converged(log[-1][0], log[-1][2]) or len(log) >= self.n_iter:
                return Descent(theta, "Success" if log[-1][0] < self.max_success_mse else "Not-converged", log, len(log))
            velocity = self.momentum * velocity + gap
            if not reach(self.alpha * velocity) < Tilt.WIDEST:
                return Descent(theta, "NA-objective", log, len(log))
            theta = theta + self.alpha * velocity

    def solve(self, tilt: Tilt, theta: np.ndarray | None = None) -> Descent:
        return answer(self.ask(np.zeros(len(tilt.mu)) if theta is None else theta, tilt.reach), tilt)

    def optimize(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray | None = None) -> WeightResult:
        counts = np.ones(len(z)) if counts is None else counts.astype(float)
        tilt = Tilt(z, mu, self.start(z, mu, counts), counts)
        found = self.solve(tilt)
        return found.result(tilt.at(found.theta)[0] * counts.sum() / counts)


@dataclass(frozen=True)
class TunedExponentiatedGradient:
    """W-MSE: try each learning rate for a few steps, restart the best of them.

    Columns are standardised unless all of them hold 0 and 1 only.  A rate that is given up ends the trial, as larger ones are
    too; a trial that converges is the result.  ``anchor_outcome`` starts from weights that match the outcome's mean (off by
    default).
    """

    alphas: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 0.5)
    n_tune_iter: int = 50
    n_iter: int = 2000
    abs_tol: float = 1e-8
    momentum: float = 0.9
    max_abs_tol: float = 1e-9
    max_success_mse: float = 1e-5
    min_sd: float = 1e-4
    outcome_column: int | None = None
    anchor_outcome: bool = False
    w0: np.ndarray | None = None
    name: str = "W-MSE"

    def with_initial(self, result: WeightResult) -> TunedExponentiatedGradient:
        return replace(self, w0=result.weights)

    def step(self, alpha: float, n_iter: int) -> ExponentiatedGradient:
        return ExponentiatedGradient(alpha, n_iter, self.abs_tol, self.momentum, self.max_abs_tol, self.max_success_mse)

    def ask(self, mu: np.ndarray, reach: Callable[[np.ndarray], float]) -> Dialogue:
        """All rates are tried side by side; the outcome is that of trying them one after the other."""
        zero = np.zeros(len(mu))
        runs = [self.step(a, self.n_tune_iter).ask(zero, reach) for a in self.alphas]
        asked, ended = {i: next(r) for i, r in enumerate(runs)}, {}
        while asked:
            found = yield np.vstack(list(asked.values()))
            following = {}
            for i, state in zip(asked, found, strict=True):
                try:
                    following[i] = runs[i].send([state])
                except StopIteration as end:
                    ended[i] = end.value
            # Rates after one that was given up, or that converged, would not have been tried.
            last = min((i for i, d in ended.items() if self._is_last(i, d)), default=len(runs))
            asked = {i: t for i, t in following.items() if i < last}
        trials, total = [], 0
        for i in sorted(ended):
            total += ended[i].iterations
            if ended[i].status == "NA-objective":
                break
            trials.append((ended[i].err, self.alphas[i], ended[i].theta))
            if self._is_last(i, ended[i]):
                return replace(ended[i], iterations=total)
        if not trials:
            return Descent(zero, "Failure", [], total)
        _, alpha, theta = min(trials, key=lambda t: t[0])
        found = yield from self.step(alpha, self.n_iter).ask(theta, reach)
        return replace(found, iterations=total + found.iterations)

    def _is_last(self, i: int, trial: Descent) -> bool:
        return trial.status == "NA-objective" or self.step(self.alphas[i], 0).converged(trial.err, trial.worst)

    def solve(self, tilt: Tilt) -> Descent:
        return answer(self.ask(tilt.mu, tilt.reach), tilt)

    def optimize(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray | None = None) -> WeightResult:
        counts = np.ones(len(z)) if counts is None else counts.astype(float)
        plain = bool(np.isin(z, (0, 1)).all())
        if not plain:
            z, mu = standardise(z, mu, counts, self.min_sd)
        start = ExponentiatedGradient(outcome_column=self.outcome_column if self.anchor_outcome and plain else None, w0=self.w0)
        tilt = Tilt(z, mu, start.start(z, mu, counts), counts)
        found = self.solve(tilt)
        weights = np.full(len(z), np.nan) if found.status == "Failure" else tilt.at(found.theta)[0] * counts.sum() / counts
        return found.result(weights)


@dataclass(frozen=True)
class ReweightSettings:
    """Settings of the convex problem; names are checked as they are given."""

    divergence: str = "entropy"
    lam: float = 0.1
    min_sd: float = 1e-4
    min_w: float = 0.0
    distance: str = "l2"
    method: str = "dual"

    def __post_init__(self) -> None:
        for value, allowed in ((self.divergence, ("entropy", "chi2")), (self.distance, ("l2", "l1")), (self.method, ("dual", "primal"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")


def _project(nu: np.ndarray, lam: float, distance: str) -> np.ndarray:
    """Onto the ball of radius 1 / lam that the distance has as its dual: Euclidean for l2, a box for l1."""
    if lam <= 0:
        return nu
    radius = 1 / lam
    if distance == "l1":
        return np.clip(nu, -radius, radius)
    norm = np.linalg.norm(nu)
    return nu if norm <= radius else nu * (radius / norm)


def _entropy_dual(z: np.ndarray, mu: np.ndarray, counts: np.ndarray, nu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Value log sum c exp(-z nu) + mu nu, gradient and weights (sums over rows, adding up to 1)."""
    t = -(z @ nu)
    top = t.max()
    e = counts * np.exp(t - top)
    s = e.sum()
    w = e / s
    return float(top + np.log(s) + mu @ nu), mu - z.T @ w, w


def solve_entropy(z: np.ndarray, mu: np.ndarray, counts: np.ndarray, lam: float, distance: str = "l2", tol: float = 1e-9, n_iter: int = 20000) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimise distance(means, mu) + lam * sum w log w through its dual: (weights, multipliers, converged).

    Without lam, damped Newton steps; with it, accelerated projected gradient steps of adaptive length, restarted when the
    value rises.
    """
    m = z.shape[1]
    nu = np.zeros(m)
    if lam <= 0:
        value, grad, w = _entropy_dual(z, mu, counts, nu)
        for _ in range(200):
            if np.abs(grad).max(initial=0.0) < tol:
                return w, nu, True
            mean = z.T @ w
            hessian = (z * w[:, None]).T @ z - np.outer(mean, mean) + 1e-12 * np.eye(m)
            step = np.linalg.lstsq(hessian, grad, rcond=None)[0]
            size = 1.0
            while size > 1e-10:
                trial = _entropy_dual(z, mu, counts, nu - size * step)
                if trial[0] <= value - 1e-4 * size * (grad @ step):
                    break
                size /= 2
            else:
                break
            nu = nu - size * step
            value, grad, w = trial
            if np.linalg.norm(nu) > 1e6:  # the means are out of reach
                return w, nu, False
        return w, nu, bool(np.abs(grad).max(initial=0.0) < 1e-6)
    tilt = Tilt(z, mu, counts)
    nu, good = projected_descent(tilt, lam, distance, tol, n_iter)
    return tilt.at(nu)[0], nu, good


def projected_descent(tilt: Tilt, lam: float, distance: str = "l2", tol: float = 1e-9, n_iter: int = 20000) -> tuple[np.ndarray, bool]:
    """Multipliers that minimise the dual within the ball of ``lam``: accelerated steps of adaptive length, restarted when it rises."""

    def dual(at: np.ndarray) -> tuple[float, np.ndarray]:
        gap, _, scale = tilt.state(at)
        return scale + float(tilt.mu @ at), -gap

    nu = np.zeros(len(tilt.mu))
    ahead, pace, step, moved = nu.copy(), 1.0, 1.0, np.inf
    value = dual(nu)[0]
    for _ in range(n_iter):
        f, g = dual(ahead)
        while True:
            new = _project(ahead - step * g, lam, distance)
            d = new - ahead
            fn, gn = dual(new)
            if fn <= f + g @ d + d @ d / (2 * step) + 1e-15 or step < 1e-14:
                break
            step /= 2
        moved = np.abs(_project(new - gn, lam, distance) - new).max(initial=0.0)
        if fn > value:
            ahead, pace, value = nu.copy(), 1.0, np.inf
            continue
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead = new + (pace - 1) / faster * (new - nu)
        nu, value, pace, step = new, fn, faster, step * 1.1
        if moved < tol:
            return nu, True
    return nu, bool(moved < 1e-5)


def model_step(at: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, bound: Callable[[np.ndarray], np.ndarray] | None, n_iter: int = 5000) -> np.ndarray:
    """The step to the lowest point of a quadratic model, within a convex set if there is one."""
    hessian = hessian + 1e-12 * max(1.0, float(np.trace(hessian))) * np.eye(len(at))
    free = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    if bound is None or np.allclose(bound(at + free), at + free, rtol=0, atol=1e-14):
        return free
    steep = float(np.linalg.eigvalsh(hessian)[-1])
    step, ahead, pace = np.zeros(len(at)), np.zeros(len(at)), 1.0
    for _ in range(n_iter):
        new = bound(at + ahead - (gradient + hessian @ ahead) / steep) - at
        if (ahead - new) @ (new - step) > 0:
            pace, ahead = 1.0, new
        else:
            faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
            ahead, pace = new + (pace - 1) / faster * (new - step), faster
        moved, step = np.abs(new - step).max(initial=0.0), new
        if moved < 1e-15:
            break
    return step


def newton(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], size: int, bound: Callable[[np.ndarray], np.ndarray] | None = None, tol: float = 1e-9, most: int = 80) -> tuple[np.ndarray, float, int]:
    """Lowest point of a convex function in a convex set: (point, how far a gradient step still moves it, evaluations).

    ``evaluate`` gives value, gradient and Hessian, from one pass over a table.  Steps are halved until the value falls enough.
    """
    inside = bound or (lambda x: x)
    at = np.zeros(size)
    value, gradient, hessian = evaluate(at)
    n = 1
    while True:
        rest = float(np.abs(inside(at - gradient) - at).max(initial=0.0))
        if rest < tol or n >= most or np.linalg.norm(at) > 1e6:
            return at, rest, n
        step = model_step(at, gradient, hessian, bound)
        part = 1.0
        while True:
            found = evaluate(at + part * step)
            n += 1
            # Near the end a value that stays within rounding counts as falling.
            if found[0] <= value + 1e-4 * part * float(gradient @ step) + 1e-14 * abs(value) or part < 1e-6 or n >= most:
                break
            part /= 2
        if not found[0] <= value + 1e-12 * max(1.0, abs(value)):
            return at, rest, n
        at, (value, gradient, hessian) = at + part * step, found


def solve_chi2(z: np.ndarray, mu: np.ndarray, counts: np.ndarray, lam: float, min_w: float = 0.0, distance: str = "l2", tol: float = 1e-10, n_iter: int = 50000) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimise distance(means, mu) + lam * ||w - 1/n||^2 with w >= min_w, or the divergence alone under equal means if lam is 0.

    The dual variable u is bounded by the distance's dual ball (unbounded for lam 0, where lam is set to 1).  For given u the
    weights are w = max(min_w, 1/n - (z u + b) / (2 lam)) with b such that they add up to 1: a projection on the simplex.
    """
    n, scale = counts.sum(), lam if lam > 0 else 1.0

    def primal(u: np.ndarray) -> np.ndarray:
        base = 1 / n - z @ u / (2 * scale) - min_w
        order = np.argsort(-base)
        c, s = np.cumsum(counts[order]), np.cumsum(counts[order] * base[order])
        shift = (s - (1 - n * min_w)) / c
        at = np.flatnonzero(base[order] > shift)
        b = shift[at[-1]] if len(at) else shift[-1]
        return np.maximum(base - b, 0) + min_w

    def bound(u: np.ndarray) -> np.ndarray:
        return _project(u, 1.0, distance) if lam > 0 else u

    steep = np.linalg.eigvalsh((z * counts[:, None]).T @ z)[-1] / (2 * scale) if z.shape[1] else 1.0
    u = ahead = np.zeros(z.shape[1])
    pace, rest = 1.0, np.inf
    for _ in range(n_iter):
        w = primal(ahead)
        grad = z.T @ (counts * w) - mu
        new = bound(ahead + grad / steep)
        if (new - ahead) @ (new - u) < 0 and pace > 1 and (grad @ (new - u)) < 0:
            pace, ahead = 1.0, u
            continue
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, rest = new + (pace - 1) / faster * (new - u), np.abs(new - ahead).max(initial=0.0)
        u, pace = new, faster
        if rest * steep < tol * 10:
            break
        if np.linalg.norm(u) > 1e9:
            return counts * primal(u), u, False
    w = primal(u)
    residual = np.abs(z.T @ (counts * w) - mu).max(initial=0.0)
    return counts * w, u, bool(np.isfinite(w).all() and (lam > 0 or residual < 1e-6))


def reweight_by_means(z: np.ndarray, mu: np.ndarray, settings: ReweightSettings = ReweightSettings(), counts: np.ndarray | None = None) -> WeightResult:
    """Solve the convex problem on standardised columns; weights are NaN with status Failure if it has no solution.

    One convention for lam: the divergence is the *sum* over rows, for both methods.
    """
    counts = np.ones(len(z)) if counts is None else counts.astype(float)
    n = counts.sum()
    zs, ms = standardise(z, mu, counts, settings.min_sd)
    if settings.method == "dual" or settings.divergence == "entropy":
        distance = "l2" if settings.method == "dual" else settings.distance
        w, nu, good = solve_entropy(zs, ms, counts, settings.lam, distance)
    else:
        w, nu, good = solve_chi2(zs, ms, counts, settings.lam, settings.min_w / n, settings.distance)
    if not good or not np.isfinite(w).all():
        return WeightResult(np.full(len(z), np.nan), "Failure", nu=nu)
    weights = np.maximum(w * n / counts, settings.min_w)
    rest = zs.T @ w - ms
    return WeightResult(weights, "Success", float(rest @ rest), float(np.abs(rest).max(initial=0.0)), nu=nu)


@dataclass(frozen=True)
class ConvexOptimizer:
    """CVX: the entropy dual as a weight optimizer.  It takes no initial value and reports no error or iterations."""

    lam: float = 0.1
    min_sd: float = 1e-4
    divergence: str = "entropy"
    method: str = "dual"
    distance: str = "l2"
    name: str = "CVX"

    @property
    def by_squares(self) -> bool:
        return (self.method, self.divergence) == ("primal", "chi2")

    def bound(self, nu: np.ndarray) -> np.ndarray:
        """Onto the multipliers that ``lam`` allows: all of them without it."""
        distance = "l2" if self.method == "dual" else self.distance
        return _project(nu, 1.0 if self.by_squares and self.lam > 0 else self.lam, distance)

    def optimize(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray | None = None) -> WeightResult:
        r = reweight_by_means(z, mu, ReweightSettings(self.divergence, self.lam, self.min_sd, 0.0, self.distance, self.method), counts)
        return WeightResult(r.weights, r.status, nu=r.nu)


def upsampling(n1: int, n0: int) -> int:
    """How often rows of class 1 are taken so that the classes balance."""
    return n0 // n1 if 0 < n1 < n0 / 2 else 1


@dataclass(frozen=True)
class DualSGD:
    """DUAL-SGD: steps on the entropy dual from samples of the rows, class 1 upsampled.

    The dual is log sum a exp(-z nu) + mu nu over multipliers within a ball, with ``a`` how many rows (upsampled) a different row
    stands for.  Rows stay merged: a sample is a multinomial draw of how often each of them is taken, and as large as the
    table it is the table itself.  Progress is judged on all rows, at every ``check_every``-th step, never on the sample that
    made the step.  A rate is out if multipliers leave their box.
    """

    epsilons: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0)
    n_tune_iter: int = 50
    n_iter: int = 1000
    batch: int = 20000
    momentum: float = 0.9
    schedule: str = "polynomial"  # or "exponential"
    poly_beta: float = 1.0
    decay: float = 0.001
    max_abs_nu: float = 16.0
    max_norm: float = 10.0
    improve_th: float = 1e-4
    check_every: int = 10
    max_halvings: int = 5
    outcome_column: int = 0
    min_sd: float = 1e-4
    seed: int = 1
    nu0: np.ndarray | None = None
    name: str = "DUAL-SGD"

    def with_initial(self, result: WeightResult) -> DualSGD:
        return replace(self, nu0=result.nu)

    def rate(self, epsilon: float, i: int) -> float:
        return epsilon * (np.exp(-self.decay * i) if self.schedule == "exponential" else (self.poly_beta * i + 1) ** -0.5)

    def descend(self, whole: Tilt, copies: float, epsilon: float, n_iter: int, batch_gap: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[tuple]] | None:
        """Multipliers of the best state seen and (dual value, error, norm, largest error) of the states judged; None if out."""
        nu = np.zeros(len(whole.mu)) if self.nu0 is None else self.nu0[: len(whole.mu)].astype(float)
        velocity, judged, best = np.zeros(len(nu)), [], None
        for i in range(n_iter + 1):
            gap = None
            if i % self.check_every == 0 or i == n_iter:
                gap, _, scale = whole.state(nu)
                judged.append((scale + float(whole.mu @ nu), float(gap @ gap), float(np.linalg.norm(nu)), float(np.abs(gap).max(initial=0.0))))
                if best is None or judged[-1][1] < best[0]:
                    best = (judged[-1][1], nu)
                if judged[-1][1] < self.improve_th or i == n_iter:
                    return best[1], judged
            if self.batch < copies:
                gap = batch_gap(i, nu)
            elif gap is None:
                gap = whole.state(nu)[0]
            velocity = self.momentum * velocity + self.rate(epsilon, i + 1) * gap
            nu = _project(nu + velocity, 1 / self.max_norm, "l2")
            if not np.abs(nu).max(initial=0.0) <= self.max_abs_nu:
                return None
        raise AssertionError("the last step is judged")

    def solve(self, whole: Tilt, copies: float) -> Descent:
        """``whole`` has all rows, class 1 upsampled, ``copies`` in number."""
        samples = lambda: whole.batches(self.batch, self.seed)
        trials = {e: self.descend(whole, copies, e, self.n_tune_iter, samples()) for e in self.epsilons}
        values = {e: t[1][-1][0] for e, t in trials.items() if t is not None}
        first = min(values, key=values.get) if values else min(self.epsilons) / 2
        for halving in range(self.max_halvings):
            found = self.descend(whole, copies, first / 2**halving, self.n_iter, samples())
            if found is not None:
                nu, judged = found
                gap, kl, _ = whole.state(nu)
                err = float(gap @ gap)
                return Descent(nu, "Success" if err < self.improve_th else "Not-converged", [*judged, (err, kl, float(np.abs(gap).max(initial=0.0)))], min(self.n_iter, (len(judged) - 1) * self.check_every))
        return Descent(np.zeros(len(whole.mu)), "Failure", [], 0)

    def optimize(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray | None = None) -> WeightResult:
        counts = np.ones(len(z)) if counts is None else counts.astype(float)
        case = z[:, self.outcome_column] == 1
        if not np.isin(z, (0, 1)).all():
            z, mu = standardise(z, mu, counts, self.min_sd)
        copies = counts * np.where(case, upsampling(int(counts[case].sum()), int(counts[~case].sum())), 1)
        whole = Tilt(z, mu, copies)
        found = self.solve(whole, copies.sum())
        if found.status == "Failure":
            return WeightResult(np.full(len(z), np.nan), "Failure", float("inf"), None, 0)
        return WeightResult(whole.at(found.theta)[0] * counts.sum() / counts, found.status, found.err, found.worst, found.iterations, found.log[:-1], found.theta)


@dataclass(frozen=True)
class AdamSoftmax:
    """Adam on the logits of the weights (or the weights themselves), for the mean squared error of the means.

    Steps of a constant rate may circle the optimum for ever; a run that ends without success goes on from where it is at half
    the rate.
    """

    rates: tuple[float, ...] = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3)
    n_tune_iter: int = 50
    n_iter: int = 2000
    parameterisation: str = "log"  # or "id"
    abs_tol: float = 1e-8
    max_success_mse: float = 1e-5
    min_sd: float = 1e-4
    max_halvings: int = 5
    name: str = "ADAM"

    def _run(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray, start: np.ndarray, rate: float, n_iter: int, go_on: bool) -> tuple[np.ndarray, np.ndarray, float, int]:
        x, a, b = start.copy(), np.zeros(len(z)), np.zeros(len(z))
        for i in range(1, n_iter + 1):
            if self.parameterisation == "log":
                e = counts * np.exp(x - x.max())
                w = e / e.sum()
            else:
                w = np.maximum(x, 0) * counts
                w = w / w.sum()
            rest = z.T @ w - mu
            err = float(rest @ rest)
            if err < self.abs_tol or (i == n_iter and not go_on):
                break
            g = z @ rest
            g = w * (g - w @ g) if self.parameterisation == "log" else counts * (g - w @ g) / len(z)
            g = g / max(np.abs(g).max(), 1e-300)
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            x = x - rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.999**i)) + 1e-8)
        return x, w, err, i

    def optimize(self, z: np.ndarray, mu: np.ndarray, counts: np.ndarray | None = None) -> WeightResult:
        counts = np.ones(len(z)) if counts is None else counts.astype(float)
        if not np.isin(z, (0, 1)).all():
            z, mu = standardise(z, mu, counts, self.min_sd)
        start = np.zeros(len(z)) if self.parameterisation == "log" else np.ones(len(z))
        tried = [(*self._run(z, mu, counts, start, r, self.n_tune_iter, True), r) for r in self.rates]
        x, w, err, n, rate = min(tried, key=lambda t: t[2])
        total = sum(t[3] for t in tried)
        if err >= self.abs_tol:
            for halving in range(self.max_halvings + 1):
                x, w, err, n = self._run(z, mu, counts, x, rate / 2**halving, self.n_iter, False)
                total += n
                if err < self.max_success_mse:
                    break
        rest = z.T @ w - mu
        return WeightResult(w * counts.sum() / counts, "Success" if err < self.max_success_mse else "Not-converged", err, float(np.abs(rest).max(initial=0.0)), total)
