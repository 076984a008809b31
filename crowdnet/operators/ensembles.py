"""Networks of regulators and targets from ensembles of regressions, one model of each target gene in a task of its own.

All kernels take the standardised samples of possible regulators (x) and of the target (y) and a generator of random
numbers, and give a weight for each regulator. The expression matrix goes to every executor, so its size is bounded; the
targets are dealt over the cluster. A target's random numbers depend on the seed and on the target alone, so results are
the same however the targets are dealt and after the loss of an executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdnet.operators.association import vectors

#: Cells of an expression matrix that is broadcast (8 bytes each).
MOST_CELLS = 50_000_000
#: One in VOTES regulators (and one more) gets a vote; shares of samples and regulators in a model; folds at most.
VOTES, LEAST_SHARE, MOST_SHARE, MOST_FOLDS = 20, 0.2, 0.8, 10
#: Rows of a matrix that are read at once, values of a node of a tree that are sorted at once, and values of a model that are kept for all its steps.
BLOCK, AT_ONCE, KEPT = 16_384, 200_000, 4_000_000
Kernel = Callable[["np.ndarray | Part", np.ndarray, np.random.Generator], np.ndarray]


class Part:
    """Rows and columns of a matrix. They are read in blocks of rows, so that a model needs no copy of all samples."""

    def __init__(self, x: np.ndarray, rows: np.ndarray | None = None, cols: np.ndarray | None = None):
        self.x = x
        self.rows = np.arange(x.shape[0]) if rows is None else rows
        self.cols = np.arange(x.shape[1]) if cols is None else cols
        self.shape = len(self.rows), len(self.cols)

    @staticmethod
    def of(x: np.ndarray | Part) -> Part:
        return x if isinstance(x, Part) else Part(x)

    def part(self, rows: np.ndarray | None = None, cols: np.ndarray | None = None) -> Part:
        return Part(self.x, self.rows if rows is None else self.rows[rows], self.cols if cols is None else self.cols[cols])

    def take(self) -> np.ndarray:
        return self.x[np.ix_(self.rows, self.cols)]

    def blocks(self):
        """(rows, values) of all rows in order."""
        for lo in range(0, len(self.rows), BLOCK):
            at = slice(lo, lo + BLOCK)
            yield at, self.x[np.ix_(self.rows[at], self.cols)]


def regress(expr: DataFrame, kernel: Kernel, targets: list | None = None, scale: bool = True, seed: int = 0) -> DataFrame:
    """(source, target, score): the kernel's weight of every other gene for each target (all genes, if none are named)."""
    spark = expr.sparkSession
    v = vectors(expr)
    genes, samples = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if genes * samples > MOST_CELLS:
        raise ValueError(f"{genes} genes of {samples} samples are more than {MOST_CELLS} cells")
    rows = sorted(v.toArrow().to_pylist(), key=lambda r: r["gene"])  # MOST_CELLS numbers at most
    names = [r["gene"] for r in rows]
    x = np.array([r["v"] for r in rows], float).reshape(genes, -1).T
    if scale:  # here and not in a query, so that sums don't depend on how the rows are dealt
        dev = x.std(axis=0, ddof=1)
        x = np.divide(x - x.mean(axis=0), dev, out=np.zeros_like(x), where=dev > 0)
    shared = spark.sparkContext.broadcast((names, x))
    wanted = [names.index(t) for t in targets] if targets is not None else list(range(genes))
    tasks = spark.createDataFrame([(k,) for k in wanted], "k int").repartition(max(1, min(len(wanted), 4 * spark.sparkContext.defaultParallelism)), "k")
    gene = dict(expr.dtypes)["gene"]

    def run(parts):
        own, x = shared.value
        for part in parts:
            for k in part["k"].tolist():
                others = np.delete(np.arange(len(own)), k)
                w = kernel(Part(x, cols=others), x[:, k], np.random.default_rng([seed, k]))
                yield pd.DataFrame({"source": [own[o] for o in others], "target": [own[k]] * len(others), "score": np.asarray(w, float)})

    return tasks.mapInPandas(run, f"source {gene}, target {gene}, score double")


def votes(weights: np.ndarray) -> np.ndarray:
    """1 for the largest absolute weights, one in VOTES and one more, unless they are 0."""
    w = np.abs(weights)
    out = np.zeros(len(w))
    out[np.argsort(-w, kind="stable")[: len(w) // VOTES + 1]] = 1
    return out * (w > 0)


def sampled(fit: Callable[[Part, np.ndarray, np.random.Generator], np.ndarray], models: int, regulators: tuple | None = None, samples: tuple | None = None) -> Kernel:
    """Mean votes over models of random samples and regulators, of which there are from the first to the second number."""

    def size(given: tuple | None, n: int, rng: np.random.Generator) -> int:
        lo, hi = given or (max(2, round(LEAST_SHARE * n)), max(2, round(MOST_SHARE * n)))
        return int(rng.integers(min(lo, n), min(hi, n) + 1))

    def kernel(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x, out = Part.of(x), np.zeros(x.shape[1])
        for _ in range(models):
            cols = rng.permutation(x.shape[1])[: size(regulators, x.shape[1], rng)]
            rows = rng.permutation(len(y))[: size(samples, len(y), rng)]
            out[cols] += votes(fit(x.part(rows, cols), y[rows], rng))
        return out / models

    return kernel


# penalised least squares


def lasso_path(x: np.ndarray | Part, y: np.ndarray, lambdas: int | np.ndarray = 10, least: float = 0.3, alpha: float = 1.0, rounds: int = 200, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lambdas, slopes, intercepts) by coordinate descent over falling penalties, from the one that leaves nothing to least of it."""
    x = Part.of(x)
    n, p = x.shape
    c = y - y.mean()
    mean = sum((b.sum(axis=0) for _, b in x.blocks()), np.zeros(p)) / n
    dev = np.sqrt(sum((((b - mean) ** 2).sum(axis=0) for _, b in x.blocks()), np.zeros(p)) / n)
    gram, target = np.zeros((p, p)), np.zeros(p)
    for at, b in x.blocks():
        z = np.divide(b - mean, dev, out=np.zeros_like(b), where=dev > 0)
        gram += z.T @ z
        target += z.T @ c[at]
    gram, target = gram / n, target / n
    if isinstance(lambdas, int):
        top = np.abs(target).max(initial=0.0) / max(alpha, 1e-3)
        lambdas = top * least ** (np.arange(lambdas) / max(1, lambdas - 1))
    beta, fit, out = np.zeros(p), np.zeros(p), []  # fit is gram @ beta
    for lam in lambdas:
        for _ in range(rounds):
            moved = 0.0
            for j in np.flatnonzero((beta != 0) | (np.abs(target - fit) > lam * alpha)):
                old = beta[j]
                r = target[j] - fit[j] + gram[j, j] * old
                new = np.sign(r) * max(abs(r) - lam * alpha, 0.0) / (gram[j, j] + lam * (1 - alpha)) if gram[j, j] > 0 else 0.0
                if new != old:
                    beta[j] = new
                    fit += gram[:, j] * (new - old)
                    moved = max(moved, abs(new - old))
            if moved < tolerance:
                break
        out.append(beta.copy())
    slopes = np.divide(np.array(out), dev, out=np.zeros((len(out), p)), where=dev > 0)
    return np.asarray(lambdas), slopes, y.mean() - slopes @ mean


def elastic_net(models: int = 1000, alpha: float = 0.3, lambdas: int = 10, least: float = 0.3, **sizes) -> Kernel:
    """Votes for the slopes at the penalty that predicts best in cross-validation."""

    def fit(x: Part, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        path, slopes, _ = lasso_path(x, y, lambdas, least, alpha)
        folds = max(2, min(MOST_FOLDS, round(len(y) ** 0.5)))
        fold = rng.permutation(len(y)) % folds
        errors = np.zeros(len(path))
        for k in range(folds):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            _, s, c = lasso_path(x.part(rest), y[rest], path, alpha=alpha)
            for at, b in x.part(own).blocks():
                errors += ((b @ s.T + c - y[own[at], None]) ** 2).sum(axis=0)
        return slopes[int(errors.argmin())]

    return sampled(fit, models, **sizes)


def tigress(models: int = 1000, lambdas: int = 10, least: float = 0.3, allow_low_variance: bool = False) -> Kernel:
    """Stability selection: how often a regulator is chosen along the lasso paths of random halves of the samples."""

    def kernel(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x, n = Part.of(x), len(y)
        enough = 1 if allow_low_variance else int(np.ceil(np.sqrt(n / 2)))
        chosen, done, failed = np.zeros(x.shape[1]), 0, 0
        while done < models:
            order = rng.permutation(n)
            halves = order[: (n + 1) // 2], order[(n + 1) // 2 :]
            if min(len(np.unique(y[h])) for h in halves) < enough:
                failed += 1
                if failed > 1000:
                    return np.zeros(x.shape[1])
                continue
            for h in halves:
                chosen += (lasso_path(x.part(h), y[h], lambdas, least)[1] != 0).sum(axis=0)
            done += 1
        return chosen / (2 * models * lambdas)

    return kernel


# support vectors


def linear_svr(x: np.ndarray | Part, y: np.ndarray, penalty: float = 1.0, width: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Slopes of the linear model with a squared loss beyond width, by Newton steps over the samples outside it."""
    x = Part.of(x)
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        gram, right = np.zeros((len(w), len(w))), np.zeros(len(w))
        for at, b in x.blocks():
            z = np.column_stack([b, np.ones(len(b))])
            off = y[at] - z @ w
            active = np.abs(off) > width
            a = z[active]
            gram += a.T @ a
            right += a.T @ (y[at][active] - np.sign(off[active]) * width)
        new = np.linalg.solve(np.eye(len(w)) + 2 * penalty * gram, 2 * penalty * right)
        if np.abs(new - w).max() < 1e-6:
            return new[:-1]
        w = new
    return w[:-1]


def llr(models: int = 1000, penalty: float = 1.0, width: float = 0.1, **sizes) -> Kernel:
    return sampled(lambda x, y, _: linear_svr(x, y, penalty, width), models, **sizes)


def _kernel_matrix(x: np.ndarray, kind: str, degree: int, gamma: float, offset: float) -> np.ndarray:
    products = x @ x.T
    if kind == "linear":
        return products
    if kind == "poly":
        return (gamma * products + offset) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * products + offset)
    if kind == "rbf":
        squares = np.diag(products)
        return np.exp(-gamma * np.maximum(squares[:, None] + squares - 2 * products, 0))
    raise ValueError(f"no kernel {kind}")


def svr_coefficients(k: np.ndarray, y: np.ndarray, penalty: float, width: float, rounds: int = 200, tolerance: float = 1e-3) -> np.ndarray:
    """Coefficients of the samples in a support vector regression, one at a time; the intercept is penalised as a constant kernel."""
    k = k + 1
    beta, fit = np.zeros(len(y)), np.zeros(len(y))
    diagonal = np.maximum(np.diag(k), 1e-12)
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(y)):
            r = y[i] - fit[i] + diagonal[i] * beta[i]
            new = float(np.clip(np.sign(r) * max(abs(r) - width, 0.0) / diagonal[i], -penalty, penalty))
            if new != beta[i]:
                fit += k[:, i] * (new - beta[i])
                moved = max(moved, abs(new - beta[i]))
                beta[i] = new
        if moved < tolerance:
            break
    return beta


def linear_epsilon_svr(x: np.ndarray | Part, y: np.ndarray, penalty: float = 1.0, width: float = 0.1, tolerance: float = 1e-8, rounds: int = 100) -> np.ndarray:
    """Slopes of the linear support vector regression whose loss is the error beyond width; the intercept is penalised as well.

    The same model as svr_coefficients() of a linear kernel, without a matrix of all samples: an interior point method for
    the coefficients q of errors above and below, each from 0 to penalty, whose steps need one matrix of the columns only.
    """
    x = Part.of(x)
    n = len(y)
    with_ones = lambda b: np.column_stack([b, np.ones(len(b))])
    kept = [(at, with_ones(b)) for at, b in x.blocks()] if n * (x.shape[1] + 1) <= KEPT else None
    blocks = lambda: kept if kept is not None else ((at, with_ones(b)) for at, b in x.blocks())
    q, low, high = np.full((2, n), penalty / 2), np.ones((2, n)), np.ones((2, n))
    sign, offset = np.array([[1.0], [-1.0]]), np.stack([width - y, width + y])
    w, fit = np.zeros(x.shape[1] + 1), np.zeros(n)  # q is the same for both signs at first
    for _ in range(rounds):
        gradient = sign * fit + offset
        gap = float((low * q).sum() + (high * (penalty - q)).sum()) / (4 * n)
        if gap < tolerance and np.abs(gradient - low + high).max() < 1e-6:
            break
        aim = gap / 10
        d = low / q + high / (penalty - q)
        h = -gradient + aim / q - aim / (penalty - q)
        weights, right = (1 / d).sum(axis=0), (sign * h / d).sum(axis=0)
        curve, pull = np.eye(len(w)), np.zeros(len(w))
        for at, z in blocks():
            curve += z.T @ (z * weights[at, None])
            pull += z.T @ right[at]
        dw, along = np.linalg.solve(curve, pull), np.empty(n)
        for at, z in blocks():
            along[at] = z @ dw
        dq = (h - sign * along) / d
        dlow, dhigh = (aim - low * dq) / q - low, (aim + high * dq) / (penalty - q) - high
        t = 1.0
        for value, change in ((q, dq), (penalty - q, -dq), (low, dlow), (high, dhigh)):
            t = min(t, 0.99 / max(0.99, float((-change / value).max())))
        q, low, high, w, fit = q + t * dq, low + t * dlow, high + t * dhigh, w + t * dw, fit + t * along
    return w[:-1]


def svm(models: int = 1000, kind: str = "epsilon", kernel: str = "linear", degree: int = 3, gamma: float = 0.01, offset: float = 0.01, nu: float = 0.5, penalty: float = 1.0, width: float = 0.1, tolerance: float = 1e-3, **sizes) -> Kernel:
    """Votes for the weights of support vectors. kind nu finds the width at which coefficients use nu of what they may.

    All but linear models of kind epsilon need a matrix of all pairs of a model's samples.
    """

    def fit(x: Part, y: np.ndarray, _: np.random.Generator) -> np.ndarray:
        if kind == "epsilon" and kernel == "linear":
            return linear_epsilon_svr(x, y, penalty, width)
        x = x.take()
        k = _kernel_matrix(x, kernel, degree, gamma, offset)
        if kind == "epsilon":
            return svr_coefficients(k, y, penalty, width, tolerance=tolerance) @ x
        lo, hi = 0.0, float(np.abs(y).max())
        for _ in range(12):
            mid = (lo + hi) / 2
            beta = svr_coefficients(k, y, penalty, mid, tolerance=tolerance)
            lo, hi = (mid, hi) if np.abs(beta).sum() > nu * penalty * len(y) else (lo, mid)
        return beta @ x

    return sampled(fit, models, **sizes)


# partial least squares


def importance(x: np.ndarray, y: np.ndarray, components: int) -> np.ndarray:
    """How much each column of x matters in components of partial least squares, by the variance of y that these explain."""
    x, y = x - x.mean(axis=0), y - y.mean()
    cov = x.T @ y
    base: list[np.ndarray] = []
    squares, explained = np.zeros(x.shape[1]), 0.0
    for _ in range(min(components, *x.shape)):
        size = np.linalg.norm(cov)
        if size < 1e-12:
            break
        u = cov / size
        t = x @ u
        norm = np.linalg.norm(t)
        if norm < 1e-12:
            break
        share = (size / norm) ** 2
        squares += share * (u / norm) ** 2
        explained += share
        v = x.T @ (t / norm)
        for b in base * 2:  # twice, for numbers' sake
            v = v - b * (b @ v)
        v /= np.linalg.norm(v)
        base.append(v)
        cov = cov - v * (v @ cov)
    return x.shape[1] * squares / explained if explained else squares


def plsnet(models: int = 1000, components: int = 5, regulators: int | None = None) -> Kernel:
    """Summed importance over bootstrap samples of random regulators."""

    def kernel(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x, out = Part.of(x), np.zeros(x.shape[1])
        n = regulators or max(1, int(np.sqrt(x.shape[1])))
        for _ in range(models):
            rows, cols = rng.integers(0, len(y), len(y)), rng.permutation(x.shape[1])[:n]
            out[cols] += importance(x.part(rows, cols).take(), y[rows], components)
        return out

    return kernel


# forests


def _best_split(x: Part, rows: np.ndarray, cols: np.ndarray, target: np.ndarray) -> tuple[float, int, int, np.ndarray]:
    """(gain, last row of the left part, place in cols, order of rows) of the split that takes off most; of equal ones the first by row, then by column."""
    n = len(rows)
    k = np.arange(1, n)
    shares = 1.0 / k + 1.0 / (n - k)
    if n * len(cols) <= AT_ONCE:
        own = x.x[np.ix_(x.rows[rows], x.cols[cols])]
        order = np.argsort(own, axis=0, kind="stable")
        values = np.take_along_axis(own, order, axis=0)
        left = np.cumsum(target[order], axis=0)[:-1]
        gain = np.where(values[1:] > values[:-1], left * left * shares[:, None], -1.0)
        at, col = np.unravel_index(int(gain.argmax()), gain.shape)
        return float(gain[at, col]), int(at), int(col), order[:, col]
    best = None
    for col in range(len(cols)):  # one column at a time bounds what is held
        own = x.x[x.rows[rows], x.cols[cols[col]]]
        order = np.argsort(own, kind="stable")
        own = own[order]
        left = np.cumsum(target[order])[:-1]
        gain = np.where(own[1:] > own[:-1], left * left * shares, -1.0)
        at = int(gain.argmax())
        if best is None or (gain[at], -at) > (best[0], -best[1]):
            best = float(gain[at]), at, col, order
    return best


def _grow(x: Part, y: np.ndarray, rows: np.ndarray, tries: int, least: int, rng: np.random.Generator, out: np.ndarray) -> None:
    """Add what each split of one tree of the samples in rows takes off the squared error to its column in out."""
    todo = [rows]
    while todo:
        rows = todo.pop()
        n = len(rows)
        if n <= least or n < 2:
            continue
        cols = rng.permutation(x.shape[1])[:tries]
        gain, at, col, order = _best_split(x, rows, cols, y[rows] - y[rows].mean())
        if gain <= 1e-12:
            continue
        out[cols[col]] += gain
        todo += [rows[order[: at + 1]], rows[order[at + 1 :]]]


def genie3(models: int = 1000, tries: int | None = None, least: int = 5) -> Kernel:
    """Mean decrease of the squared error in a forest of trees over bootstrap samples; tries columns are looked at for a split."""

    def kernel(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        x, out = Part.of(x), np.zeros(x.shape[1])
        for _ in range(models):
            rows = rng.integers(0, len(y), len(y))
            _grow(x, y, rows, tries or max(1, int(np.sqrt(x.shape[1]))), least, rng, out)
        return out / models

    return kernel


# recursive optimisation


def least_deviations(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Slopes that minimise the absolute errors plus the absolute slopes: both are errors of one larger system."""
    a, b = np.vstack([x, np.eye(x.shape[1])]), np.concatenate([y, np.zeros(x.shape[1])])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    small = 1.0
    for _ in range(rounds):
        w = 1 / np.sqrt((b - a @ beta) ** 2 + small * small)
        aw = a * w[:, None]
        new = np.linalg.solve(a.T @ aw, aw.T @ b)
        if np.abs(new - beta).max() < 1e-9 and small <= 1e-8:
            return new
        beta, small = new, max(small / 2, 1e-8)
    return beta


def gaussian_information(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mutual information of each column with y if all are Gaussian; 10 where it isn't a number."""
    r = np.array([np.corrcoef(c, y)[0, 1] for c in x.T])
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -0.5 * np.log(1 - r * r)
    return np.where(np.isfinite(out), out, 10.0)


def narromi(alpha: float = 0.05, share: float = 0.6) -> Kernel:
    """Signed mix of information and of slopes from absolute-error regressions that drop slopes below alpha until none is."""

    def kernel(x: np.ndarray, y: np.ndarray, _: np.random.Generator) -> np.ndarray:
        x = Part.of(x).take()
        information = gaussian_information(x, y)
        value = information.copy()
        index = np.flatnonzero(np.abs(information) >= alpha)
        while len(index):
            slopes = least_deviations(x[:, index], y)
            value[index] = slopes
            kept = np.abs(slopes) >= alpha
            if kept.all():
                break
            index = index[kept]
        return np.sign(value) * (np.abs(value) * share + information * (1 - share))

    return kernel


def significance(values: np.ndarray) -> np.ndarray:
    """How likely a normal distribution gives more than each value, after values are scaled to 0..1 and stretched at 1.

    The largest value has no stretched one and gets the next one's. The deviation is the variance of the stretched values.
    """
    z = (values - values.min()) / (values.max() - values.min())
    top = z == 1
    z = np.where(top, 0.0, z)
    z = 0.5 * np.log2((1 + z) / (1 - z))
    z[top] = z[~top].max()
    return np.array([0.5 * math.erfc((v - z.mean()) / (z.var(ddof=1) * math.sqrt(2))) for v in z])


#: The kernels by the name of their network.
KERNELS: dict[str, Callable[..., Kernel]] = {"genie3": genie3, "elnet": elastic_net, "tigress": tigress, "plsnet": plsnet, "llr": llr, "svm": svm, "narromi": narromi}
