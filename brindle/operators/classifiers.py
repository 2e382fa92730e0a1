"""Binary classifiers that are fitted in one task, and kept as JSON.

Every option is honoured, can't change a result (INERT), or is refused. Types for other hardware are names of the same method.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import numpy as np


def _sigmoid(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def class_weights(how, n: int, positives: float) -> tuple[float, float]:
    """Weights of examples of the classes 0 and 1 among n: how is None, "balanced" or one for each class."""
    if how is None:
        return 1.0, 1.0
    if isinstance(how, dict):
        of = {int(k): float(v) for k, v in how.items()}
        return of.get(0, 1.0), of.get(1, 1.0)
    if how != "balanced":
        raise ValueError(f"unknown class weights {how!r}")
    return n / (2 * max(1, n - positives)), n / (2 * max(1, positives))


def _weights(y: np.ndarray, how) -> np.ndarray:
    zero, one = class_weights(how, len(y), float(y.sum()))
    return np.where(y > 0, one, zero)


class Classifier:
    """known: options with their defaults; only: options of which some values are known; a target of one class makes a constant model."""

    known: dict = {}
    only: dict = {}
    #: Options that say how fast, how loudly or where to work.
    INERT = frozenset(("n_jobs", "verbose", "verbosity", "device", "handle", "output_type", "cache_size", "importance_type", "linesearch_max_iter"))
    is_linear_model = False
    supports_partial_fit = False

    def __init__(self, **kwargs):
        if wrong := set(kwargs) - set(self.known) - set(self.only) - self.INERT:
            raise ValueError(f"unknown parameters of {type(self).__name__}: {sorted(wrong)}")
        for name, allowed in self.only.items():
            if name in kwargs and kwargs[name] not in allowed:
                raise ValueError(f"{type(self).__name__} knows {name} only as {list(allowed)}, not {kwargs[name]!r}")
        self.kwargs, self.state = kwargs, {}

    def get(self, name):
        return self.kwargs.get(name, self.known.get(name))

    def rng(self, more: int = 0) -> np.random.Generator:
        return np.random.default_rng((self.get("random_state") or 0) * 1009 + more)

    @property
    def classes(self) -> list[int]:
        return [0, 1] if "constant" not in self.state else [int(self.state["constant"])]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Classifier:
        self.state = {}
        if y.min() == y.max():
            self.state["constant"] = float(y[0])
        else:
            self._fit(x.astype(float), y.astype(float))
        return self

    def decision_function(self, x: np.ndarray) -> np.ndarray:
        if "constant" in self.state:
            return np.full(len(x), 30.0 if self.state["constant"] else -30.0)
        return self._decision(x.astype(float))

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        p = _sigmoid(self.decision_function(x))
        return np.stack((1 - p, p), 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.decision_function(x) > 0).astype(int)

    def dumps(self) -> str:
        kind = next(k for k, v in CLASSIFIERS.items() if v is type(self))
        return json.dumps({"type": kind, "kwargs": self.kwargs, "state": self.state})

    @staticmethod
    def loads(text: str) -> Classifier:
        held = json.loads(text)
        out = CLASSIFIERS[held["type"]](**held["kwargs"])
        out.state = held["state"]
        return out


class Linear(Classifier):
    is_linear_model = True

    @property
    def coef(self) -> list[float] | None:
        return self.state.get("coef")

    @property
    def intercept(self) -> float:
        if "constant" in self.state:
            return 30.0 if self.state["constant"] else -30.0
        return self.state["intercept"]

    def _decision(self, x):
        return x @ np.array(self.state["coef"]) + self.state["intercept"]


class LogisticRegression(Linear):
    """The sum of the losses times C, plus the penalty: by Newton steps in the smaller of features and rows, or by accelerated proximal
    steps where the penalty has absolute values. All solvers have the same solution. tol bounds the last change of a coefficient."""

    known = {"C": 1.0, "penalty": "l2", "l1_ratio": None, "fit_intercept": True, "class_weight": None, "max_iter": 100, "tol": 1e-4, "random_state": None}
    only = {
        "solver": ("lbfgs", "liblinear", "newton-cg", "newton-cholesky", "sag", "saga", "qn", None), "dual": (False,), "intercept_scaling": (1, 1.0), "warm_start": (False,), "multi_class": (None, "auto", "ovr", "deprecated"),
    }

    def _fit(self, x, y):
        penalty = self.get("penalty")
        if penalty not in ("l2", "l1", "elasticnet", "none", None):
            raise ValueError(f"unknown penalty {penalty!r}")
        share = {"l1": 1.0, "elasticnet": self.get("l1_ratio") or 0.0}.get(penalty, 0.0)
        strength = 0.0 if penalty in ("none", None) else 1 / self.get("C")
        weight = _weights(y, self.get("class_weight"))
        ones = np.hstack((x, np.ones((len(x), 1)))) if self.get("fit_intercept") else x
        solve = self._proximal if share else self._newton
        w = solve(ones, y, weight, strength * (1 - share), strength * share)
        self.state |= {"coef": w[: x.shape[1]].tolist(), "intercept": float(w[-1]) if self.get("fit_intercept") else 0.0}

    def _newton(self, x, y, weight, square, _):
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), max(square, 1e-8))
        if self.get("fit_intercept"):
            ridge[-1] = 1e-8
        for _round in range(self.get("max_iter")):
            p = _sigmoid(x @ w)
            slope = x.T @ (weight * (p - y)) + ridge * w
            h = weight * np.maximum(p * (1 - p), 1e-9)
            if len(w) <= len(x):
                step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(ridge), slope)
            else:
                scaled = x / ridge
                inner = np.diag(1 / h) + scaled @ x.T
                step = slope / ridge - scaled.T @ np.linalg.solve(inner, scaled @ slope)
            w -= step
            if np.abs(step).max() <= self.get("tol"):
                break
        return w

    def _proximal(self, x, y, weight, square, absolute):
        free = np.ones(x.shape[1])
        if self.get("fit_intercept"):
            free[-1] = 0.0
        rate = 1 / (np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 / 4 + square + 1e-12)
        w = v = np.zeros(x.shape[1])
        t = 1.0
        for _round in range(self.get("max_iter") * 10):  # a step costs far less than one of Newton's
            slope = x.T @ (weight * (_sigmoid(x @ v) - y)) + square * free * v
            new = v - rate * slope
            new = np.sign(new) * np.maximum(np.abs(new) - rate * absolute * free, 0)
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, change = new + (t - 1) / t_new * (new - w), np.abs(new - w).max()
            w, t = new, t_new
            if change <= self.get("tol") * 0.01:
                break
        return w


#: Loss and its slope, by margin (the decision times the sign of the target).
LOSSES: dict[str, tuple[Callable, Callable]] = {
    "hinge": (lambda m: max(0.0, 1 - m), lambda m: -1.0 if m < 1 else 0.0),
    "perceptron": (lambda m: max(0.0, -m), lambda m: -1.0 if m <= 0 else 0.0),
    "squared_hinge": (lambda m: max(0.0, 1 - m) ** 2, lambda m: -2 * (1 - m) if m < 1 else 0.0),
    "modified_huber": (lambda m: max(0.0, 1 - m) ** 2 if m >= -1 else -4 * m, lambda m: 0.0 if m >= 1 else -2 * (1 - m) if m >= -1 else -4.0),
    "log_loss": (lambda m: float(np.log1p(np.exp(-m))) if m > -30 else -m, lambda m: -1 / (1 + float(np.exp(min(m, 500.0))))),
}

#: The most that a loss with unbounded slopes is curved: a longer step than its inverse would go beyond the least.
CURVATURES = {"squared_hinge": 2.0, "modified_huber": 2.0}


#: Fixed value: how much slower the intercept moves than coefficients, as customary for sparse rows.
DECAY = 0.01


class SGD(Linear):
    """One example at a time, in an order drawn from the seed.

    Rates: optimal, 1 / (alpha (t0 + t)) with a t0 that suits the rows' mean squared length and the loss's curvature; constant, eta0; invscaling, eta0 / t ** power_t; adaptive, eta0,
    a fifth of it whenever passes bring no more. A fit ends after max_iter passes, or when the loss (with early_stopping: the
    accuracy on a part kept back) hasn't been better by tol for n_iter_no_change of them. Coefficients are those of the pass after which the objective (or that accuracy)
    was best, so they don't hang on how the last rows fell.
    """

    known = {
        "loss": "hinge", "penalty": "l2", "alpha": 1e-4, "l1_ratio": 0.15, "fit_intercept": True, "max_iter": 1000, "tol": 1e-3, "shuffle": True, "epsilon": 0.1, "random_state": None, "learning_rate": "optimal", "eta0": 0.01,
        "power_t": 0.5, "early_stopping": False, "validation_fraction": 0.1, "n_iter_no_change": 5, "class_weight": None, "average": False,
    }
    only = {"warm_start": (False,)}
    supports_partial_fit = True

    def __init__(self, **kwargs):
        super().__init__(**kwargs)
        for name, allowed in (("loss", LOSSES), ("penalty", ("l2", "l1", "elasticnet", None)), ("learning_rate", ("optimal", "constant", "invscaling", "adaptive"))):
            if self.get(name) not in allowed:
                raise ValueError(f"unknown {name} {self.get(name)!r}")
        if self.get("learning_rate") != "optimal" and not self.get("eta0"):
            raise ValueError("this learning rate needs an eta0 above 0")

    def _fit(self, x, y):
        kept = np.zeros(len(x), bool)
        if self.get("early_stopping"):
            for c in (0, 1):
                rows = np.flatnonzero(y == c)
                kept[self.rng(7).permutation(rows)[: int(self.get("validation_fraction") * len(rows))]] = True
        own = ~kept if kept.any() and len(set(y[~kept])) == 2 else np.ones(len(x), bool)
        best, idle, first = np.inf, 0, True
        least, found = np.inf, None
        for _ in range(self.get("max_iter")):
            loss = self._pass(x[own], y[own])
            reached = self.objective(x[own], y[own])
            if self.get("early_stopping") and kept.any():
                loss = reached = 1 - float(((self._decision(x[kept]) > 0) == (y[kept] > 0)).mean())
            if found is None or reached < least:
                least, found = reached, {k: self.state[k] for k in ("coef", "intercept")}
            idle = 0 if first or self.get("tol") is None or loss < best - self.get("tol") else idle + 1
            best, first = min(best, loss), False
            if idle >= self.get("n_iter_no_change"):
                if self.get("learning_rate") != "adaptive" or self.state["rate"] <= 1e-6:
                    break
                self.state["rate"] /= 5
                idle = 0
        self.state |= found or {}

    def _strengths(self) -> tuple[float, float]:
        """Of squares and of absolute values."""
        share = {"l1": 1.0, "elasticnet": self.get("l1_ratio")}.get(self.get("penalty"), 0.0)
        alpha = 0.0 if self.get("penalty") is None else self.get("alpha")
        return alpha * (1 - share), alpha * share

    def objective(self, x: np.ndarray, y: np.ndarray) -> float:
        """The mean weighted loss and the penalty of the coefficients."""
        loss, _ = LOSSES[self.get("loss")]
        margins = np.where(y > 0, 1.0, -1.0) * self._decision(x.astype(float))
        w, (square, absolute) = np.array(self.state["coef"]), self._strengths()
        told = float((_weights(y, self.get("class_weight")) * np.fromiter(map(loss, margins.tolist()), float, len(margins))).mean())
        return told + 0.5 * square * float(w @ w) + absolute * float(np.abs(w).sum())

    def partial_fit(self, x: np.ndarray, y: np.ndarray) -> SGD:
        """One pass."""
        self._pass(x.astype(float), y.astype(float))
        return self

    def order(self, n: int, t: int) -> np.ndarray:
        """In which order a pass takes n rows, when t have been taken before it."""
        return self.rng(t).permutation(n) if self.get("shuffle") else np.arange(n)

    def begin(self, length: float) -> None:
        """Set the rates before the first pass, by its rows' mean squared length."""
        s, alpha = self.state, self.get("alpha")
        if "rate" not in s:
            s["rate"] = self.get("eta0")
            typical = np.sqrt(1 / np.sqrt(alpha)) if alpha else 1.0
            first = typical / max(1.0, -LOSSES[self.get("loss")][1](-typical))
            s["t0"] = max(1.0, length) / (min(first, 0.5 / CURVATURES.get(self.get("loss"), 0.5 / first)) * alpha) if alpha else 1.0

    def _pass(self, x: np.ndarray, y: np.ndarray) -> float:
        """One pass over the rows; the mean loss on the way."""
        self.begin(float((x * x).sum(1).mean()) if len(x) else 1.0)
        total = self.steps(x, y, _weights(y, self.get("class_weight")), self.order(len(x), self.state.get("t", 0)))
        return total / max(1, len(x))

    def steps(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray) -> float:
        """Take rows one by one, in this order; the sum of their losses on the way. A pass may be taken in parts."""
        s = self.state
        w, b, t = np.array(s["raw"]) if "raw" in s else np.zeros(x.shape[1]), s.get("raw_intercept", 0.0), s.get("t", 0)
        mean, mean_b = np.array(s["mean"]) if "mean" in s else np.zeros(x.shape[1]), s.get("mean_intercept", 0.0)
        alpha, how, average = self.get("alpha"), self.get("learning_rate"), int(self.get("average"))
        square, absolute = self._strengths()
        loss, slope = LOSSES[self.get("loss")]
        sign = np.where(y > 0, 1.0, -1.0)
        total, intercept = 0.0, bool(self.get("fit_intercept"))
        for k in order.tolist():
            t += 1
            eta = 1 / (alpha * (s["t0"] + t - 1)) if how == "optimal" else s["rate"] / t ** self.get("power_t") if how == "invscaling" else s["rate"]
            row = x[k]
            margin = sign[k] * (float(row @ w) + b)
            total += weight[k] * loss(margin)
            pull = min(1e12, -slope(margin)) * weight[k] * sign[k] * eta
            if square:
                w *= max(0.0, 1 - eta * square)
            if pull:
                w += pull * row
                if intercept:
                    b += pull * DECAY
            if absolute:
                w = np.sign(w) * np.maximum(np.abs(w) - eta * absolute, 0)
            if average and t >= average:
                n = t - average + 1
                mean += (w - mean) / n
                mean_b += (b - mean_b) / n
        s |= {"raw": w.tolist(), "raw_intercept": float(b), "t": int(t)}
        if average:
            s |= {"mean": mean.tolist(), "mean_intercept": float(mean_b)}
        use_mean = average and t >= average
        s |= {"coef": (mean if use_mean else w).tolist(), "intercept": float(mean_b if use_mean else b)}
        return total


def grow(
    x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int | None = None, leaves: int | None = None, least: int = 1, least_split: int = 2, least_h: float = 0.0, l1: float = 0.0, l2: float = 0.0, least_gain: float = 0.0,
    some: Callable[[], np.ndarray] | None = None, impurity: str = "square",
) -> list[list]:
    """A tree of rows [feature, cut, left, right] or [value], the root first: the leaf with the greatest gain is split next.

    g and h are sums that a leaf's value, g / (h + l2), is made of: weighted targets and weights, or slopes and curvatures of a loss.
    """

    def strength(a):
        return np.sign(a) * np.maximum(np.abs(a) - l1, 0) if l1 else a

    def score(a, b):
        if impurity == "square":
            return strength(a) ** 2 / np.maximum(b + l2, 1e-300)
        p = np.clip(a / np.maximum(b, 1e-300), 1e-15, 1 - 1e-15)
        return b * (p * np.log(p) + (1 - p) * np.log(1 - p))

    def best(rows):
        out = (-np.inf, 0, 0.0)
        if len(rows) < max(2 * least, least_split):
            return out
        g_all, h_all = g[rows].sum(), h[rows].sum()
        for f in some() if some else range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, a, b = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if least_h:
                at = at[(b[at] >= least_h) & (h_all - b[at] >= least_h)]
            if len(at):
                gain = score(a[at], b[at]) + score(g_all - a[at], h_all - b[at]) - score(g_all, h_all)
                k = int(gain.argmax())
                if gain[k] > out[0]:
                    out = (float(gain[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
        return out

    def value(rows):
        return float(strength(g[rows].sum()) / max(h[rows].sum() + l2, 1e-300))

    tree: list[list] = [[value(np.arange(len(x)))]]
    queue: list[tuple] = []

    def offer(place, rows, level):
        if depth is None or level < depth:
            gain, f, cut = best(rows)
            if gain > max(least_gain, 1e-12):
                heapq.heappush(queue, (-gain, place, f, cut, rows, level))

    offer(0, np.arange(len(x)), 0)
    n = 1
    while queue and (leaves is None or n < leaves):
        _, place, f, cut, rows, level = heapq.heappop(queue)
        left = x[rows, f] <= cut
        tree[place] = [f, cut, len(tree), len(tree) + 1]
        for part in (rows[left], rows[~left]):
            tree.append([value(part)])
            offer(len(tree) - 1, part, level + 1)
        n += 1
    return tree


def walk(tree: list[list], x: np.ndarray) -> np.ndarray:
    """The value of each row's leaf."""
    out, stack = np.empty(len(x)), [(0, np.arange(len(x)))]
    while stack:
        place, rows = stack.pop()
        node = tree[place]
        if len(node) == 1:
            out[rows] = node[0]
        elif len(rows):
            left = x[rows, node[0]] <= node[1]
            stack += [(node[2], rows[left]), (node[3], rows[~left])]
    return out


def _how_many(how, n: int) -> int:
    """A number of features or rows: a number, a share, sqrt, log2 or all."""
    if how in ("sqrt", "auto"):
        return max(1, int(n**0.5))
    if how == "log2":
        return max(1, int(np.log2(n)))
    return n if how is None else max(1, min(n, int(how * n) if isinstance(how, float) else int(how)))


class Forest(Classifier):
    known = {
        "n_estimators": 100, "criterion": "gini", "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt", "max_leaf_nodes": None, "min_impurity_decrease": 0.0, "bootstrap": True, "random_state": None,
        "class_weight": None, "max_samples": None,
    }
    only = {"min_weight_fraction_leaf": (0.0, 0), "oob_score": (False,), "warm_start": (False,), "ccp_alpha": (0.0, 0), "monotonic_cst": (None,)}

    def _fit(self, x, y):
        if self.get("criterion") not in ("gini", "entropy", "log_loss"):
            raise ValueError(f"unknown criterion {self.get('criterion')!r}")
        rng, weight, trees = self.rng(), _weights(y, self.get("class_weight")), []
        count, n = _how_many(self.get("max_features"), x.shape[1]), _how_many(self.get("max_samples"), len(x))
        # the decrease is given per row, and for gini twice as large as in squares
        gini = self.get("criterion") == "gini"
        gain = self.get("min_impurity_decrease") * len(x) / (2 if gini else np.log2(np.e))
        for _ in range(self.get("n_estimators")):
            k = rng.integers(len(x), size=n) if self.get("bootstrap") else np.arange(len(x))
            trees.append(grow(
                x[k], (y * weight)[k], weight[k], self.get("max_depth"), self.get("max_leaf_nodes"), self.get("min_samples_leaf"), self.get("min_samples_split"), least_gain=gain,
                some=lambda: np.sort(rng.choice(x.shape[1], count, replace=False)), impurity="square" if gini else "entropy",
            ))
        self.state["trees"] = trees

    def _decision(self, x):
        p = np.clip(np.mean([walk(t, x) for t in self.state["trees"]], 0), 1e-9, 1 - 1e-9)
        return np.log(p / (1 - p))


class Boosted(Classifier):
    """Trees grown leaf by leaf on slopes and curvatures of the log loss. Cuts are exact, so there is no sample for bins."""

    known = {
        "num_leaves": 31, "max_depth": -1, "learning_rate": 0.1, "n_estimators": 100, "class_weight": None, "min_split_gain": 0.0, "min_child_weight": 1e-3, "min_child_samples": 20, "subsample": 1.0, "subsample_freq": 0,
        "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "random_state": None,
    }
    only = {"boosting_type": ("gbdt",), "objective": (None, "binary", "multiclass", "multiclassova"), "subsample_for_bin": (200000,)}

    def _fit(self, x, y):
        rng, weight, score, trees = self.rng(), _weights(y, self.get("class_weight")), np.zeros(len(x)), []
        base = float((weight * y).sum() / weight.sum())
        self.state["base"] = float(np.log(base / (1 - base)))
        score += self.state["base"]
        depth = self.get("max_depth") if self.get("max_depth") > 0 else None
        rows = np.arange(len(x))
        for k in range(self.get("n_estimators")):
            if self.get("subsample_freq") and self.get("subsample") < 1 and k % self.get("subsample_freq") == 0:
                rows = np.sort(rng.choice(len(x), max(1, int(self.get("subsample") * len(x))), replace=False))
            columns = np.sort(rng.choice(x.shape[1], _how_many(float(self.get("colsample_bytree")), x.shape[1]), replace=False))
            p = _sigmoid(score)
            tree = grow(
                x[rows], (weight * (y - p))[rows], (weight * p * (1 - p))[rows], depth, self.get("num_leaves"), self.get("min_child_samples"), least_h=self.get("min_child_weight"), l1=self.get("reg_alpha"),
                l2=self.get("reg_lambda"), least_gain=self.get("min_split_gain"), some=lambda columns=columns: columns,
            )
            trees.append(tree)
            score += self.get("learning_rate") * walk(tree, x)
            if len(tree) == 1:
                break
        self.state["trees"] = trees

    def _decision(self, x):
        return self.state["base"] + self.get("learning_rate") * np.sum([walk(t, x) for t in self.state["trees"]], 0)


class KernelSVC(Classifier):
    """Dual coordinate steps on the kernel matrix, with the bias as a feature of its own; probabilities by a logistic curve over the decisions.

    Rows are at most MOST_ROWS, as their kernel matrix is held.
    """

    MOST_ROWS = 20_000
    known = {"C": 1.0, "kernel": "rbf", "degree": 3, "gamma": "scale", "coef0": 0.0, "tol": 1e-3, "class_weight": None, "max_iter": -1, "random_state": None}
    only = {"probability": (True, False), "shrinking": (True, False), "decision_function_shape": ("ovr", "ovo"), "break_ties": (False,)}

    def _kernel(self, a, b):
        gamma, c, kind = self.state["gamma"], self.get("coef0"), self.get("kernel")
        if kind == "rbf":
            return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
        dots = a @ b.T
        if kind == "linear":
            return dots
        if kind == "poly":
            return (gamma * dots + c) ** self.get("degree")
        if kind == "sigmoid":
            return np.tanh(gamma * dots + c)
        raise ValueError(f"unknown kernel {kind!r}")

    def _fit(self, x, y):
        if len(x) > self.MOST_ROWS:
            raise ValueError(f"more than {self.MOST_ROWS} rows for a kernel matrix; choose a linear type")
        gamma = self.get("gamma")
        self.state["gamma"] = 1 / max(1e-12, x.shape[1] * x.var()) if gamma == "scale" else 1 / x.shape[1] if gamma == "auto" else float(gamma)
        k, sign, most = self._kernel(x, x) + 1, np.where(y > 0, 1.0, -1.0), self.get("C") * _weights(y, self.get("class_weight"))
        a, f, rng = np.zeros(len(x)), np.zeros(len(x)), self.rng()
        rounds = self.get("max_iter") if self.get("max_iter") > 0 else 1000
        for _ in range(rounds):
            worst = 0.0
            for i in rng.permutation(len(x)).tolist():
                slope = sign[i] * f[i] - 1
                pulled = min(slope, 0.0) if a[i] <= 0 else max(slope, 0.0) if a[i] >= most[i] else slope
                if pulled:
                    worst = max(worst, abs(pulled))
                    new = min(max(a[i] - slope / max(k[i, i], 1e-12), 0.0), most[i])
                    f += (new - a[i]) * sign[i] * k[i]
                    a[i] = new
            if worst <= self.get("tol"):
                break
        held = np.flatnonzero(a)
        curve = LogisticRegression(C=1e3).fit(f[:, None], y)
        self.state |= {"support": x[held].tolist(), "dual": (a * sign)[held].tolist(), "curve": [curve.coef[0], curve.intercept]}

    def raw_decision(self, x):
        return (self._kernel(x, np.array(self.state["support"])) + 1) @ np.array(self.state["dual"])

    def _decision(self, x):
        slope, start = self.state["curve"]
        return slope * self.raw_decision(x) + start


CLASSIFIERS: dict[str, type[Classifier]] = {
    "sklearnlogisticregression": LogisticRegression,
    "sklearnsgdclassifier": SGD,
    "sklearnrandomforestclassifier": Forest,
    "sklearnsupportvectorclassification": KernelSVC,
    "cumllogisticregression": LogisticRegression,
    "lightgbmclassifier": Boosted,
    "linear_l2": LogisticRegression,
    "sgdclassifier": SGD,
}


def register_classifier(name: str, kind: type[Classifier]) -> None:
    """Make a type known by name; workers have to import the module that does so."""
    CLASSIFIERS[name.lower()] = kind
