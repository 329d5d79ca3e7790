"""Numerical kernels without a relational form: numpy on one window of returns."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards a scaled identity (Ledoit and Wolf, 2004), and the shrinkage."""
    n, p = x.shape
    if not np.isfinite(x).all() or n <= p:
        raise ValueError("needs complete returns and more rows than assets")
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((x**2).T @ (x**2) / n - s**2).sum() / n / p, delta)
    k = 0.0 if delta == 0 else beta / delta
    return (1 - k) * s + k * mu * np.eye(p), k


def ewma(x: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """Exponentially weighted covariance, seeded by the first two rows."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    c = np.cov(x[:2].T)
    for r in x[2:]:
        c = decay * c + (1 - decay) * np.outer(r, r)
    return c


def ward_merges(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges of Ward's linkage over rows of a distance matrix, by the nearest-neighbour chain: a chain
    of ever nearer groups is followed until two are each other's nearest, which any order of merging
    would merge. A group goes by its smallest leaf; children come before parents."""
    n = len(d)
    sq = (d**2).sum(axis=1)
    sq = np.maximum(sq[:, None] + sq[None] - 2 * d @ d.T, 0)
    np.fill_diagonal(sq, np.inf)
    size, live, chain, out = np.ones(n), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        at = chain[-1]
        near = int(sq[at].argmin())
        if len(chain) > 1 and sq[at, chain[-2]] <= sq[at, near]:
            near = chain[-2]
            del chain[-2:]
            i, j = min(at, near), max(at, near)
            new = ((size[i] + size) * sq[i] + (size[j] + size) * sq[j] - size * sq[i, j]) / (size[i] + size[j] + size)
            live[j] = False
            new[~live] = new[i] = np.inf
            sq[i], sq[:, i] = new, new
            sq[j], sq[:, j] = np.inf, np.inf
            size[i] += size[j]
            out.append((i, j))
        else:
            chain.append(near)
    return out


def ward_order(d: np.ndarray) -> list[int]:
    """Leaf order of Ward's linkage: of two merged groups, that with the smaller leaf first."""
    groups = {i: [i] for i in range(len(d))}
    for i, j in ward_merges(d):
        groups[i] += groups.pop(j)
    return groups[0]


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: correlation distance, Ward order, recursive bisection."""
    sd = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(sd, sd), -1, 1)
    order = ward_order(np.sqrt((1 - corr) / 2))
    w = np.ones(len(cov))

    def risk(ix):
        v = 1 / np.diag(cov)[ix]
        v /= v.sum()
        return v @ cov[np.ix_(ix, ix)] @ v

    todo = [order]
    while todo:
        ix = todo.pop()
        if len(ix) > 1:
            a, b = ix[: len(ix) // 2], ix[len(ix) // 2 :]
            share = 1 - risk(a) / (risk(a) + risk(b))
            w[a] *= share
            w[b] *= 1 - share
            todo += [a, b]
    return w / w.sum()


def _prox(z: np.ndarray, previous: np.ndarray, charge: float, low: float, high: float) -> np.ndarray:
    """Nearest point to ``z`` under charge * |w - previous|, sum 1 and low <= w <= high, all at once: for
    the sum's multiplier m each weight is the clipped soft threshold of z - m, and m is bisected."""
    at = lambda m: np.clip(previous + np.sign(z - m - previous) * np.maximum(np.abs(z - m - previous) - charge, 0), low, high)
    a, b = (z - high).min() - charge - 1, (z - low).max() + charge + 1
    for _ in range(100):
        m = (a + b) / 2
        a, b = (m, b) if at(m).sum() > 1 else (a, m)
    x, y = at(a), at(b)  # sums just above and below 1, linear in between
    over, under = x.sum() - 1, 1 - y.sum()
    return x if over <= 0 else (under * x + over * y) / (over + under)


def duality_gap(w: np.ndarray, gain: np.ndarray, previous: np.ndarray, cost: float, low: float, high: float) -> float:
    """Bound on what any feasible book can add to gain'w - cost |w - previous|. For the gradient of a
    concave objective at w it bounds how far w is from the optimum: books start at ``low`` and the
    steepest pieces, on either side of the previous weights, are filled until the sum is 1."""
    kink = np.clip(previous, low, high)
    # below a previous weight the cost falls, above it the cost rises
    slope = np.concatenate((np.where(previous > low, gain + cost, gain - cost), gain - cost))
    room = np.concatenate((kink - low, high - kink))
    slope[: len(w)][previous >= high] = (gain + cost)[previous >= high]
    by = np.argsort(-slope, kind="stable")
    left = 1 - low * len(w)
    fill = np.clip(left - np.concatenate(([0.0], np.cumsum(room[by])[:-1])), 0, room[by])
    v = np.full(len(w), low, float)
    np.add.at(v, by % len(w), fill)
    value = lambda x: gain @ x - cost * np.abs(x - previous).sum()
    return float(value(v) - value(w))


def bl_posterior(cov: np.ndarray, prior: np.ndarray, p: np.ndarray, q: np.ndarray, confidence: np.ndarray, tau: float = 0.05):
    """Black-Litterman mean and the covariance of that mean; a view's variance shrinks with its confidence."""
    base = p @ (tau * cov) @ p.T
    sure = np.clip(confidence, 1e-6, 1 - 1e-6)
    omega = np.diag(np.diag(base) * (1 - sure) / sure)
    gain = tau * cov @ p.T @ np.linalg.inv(base + omega)
    return prior + gain @ (q - p @ prior), tau * cov - gain @ p @ (tau * cov)


def positive(cov: np.ndarray) -> np.ndarray:
    """Nearest matrix with eigenvalues of 1e-8 or more."""
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    return (vector * np.maximum(value, 1e-8)) @ vector.T


def class_views(classes: list[str]) -> tuple[np.ndarray, list[str]]:
    """(views, classes in order): a row for each class, equal weights of its members."""
    names = sorted(set(classes))
    p = np.array([[float(c == n) for c in classes] for n in names])
    return p / p.sum(axis=1, keepdims=True), names


def bl_weights(
    cov: np.ndarray, market: np.ndarray, p: np.ndarray, score: np.ndarray, confidence: np.ndarray, tau: float = 0.025, aversion: float = 2.5,
    tilt: float = 0.03, cost: float = 0.02, low: float = 0.0, high: float = 0.2,
) -> np.ndarray:
    """Black-Litterman weights: each view expects its portfolio's equilibrium return plus score * tilt.

    Turnover is charged against equal weights. Without views, or with bounds that no book meets,
    the market weights.
    """
    n = len(cov)
    if not len(p) or n * low > 1 or n * high < 1:
        return market
    prior = aversion * cov @ market
    mu, post = bl_posterior(cov, prior, p, p @ prior + score * tilt, confidence, tau)
    return mean_variance(mu, positive(cov + post), np.full(n, 1 / n), aversion, cost, low, high)


def ticker_bl(cov: np.ndarray, market: np.ndarray, score: np.ndarray, confidence: np.ndarray, least: float = 0.05, tilt: float = 0.05, **rest) -> np.ndarray:
    """Black-Litterman with a view on each asset whose confidence is ``least`` or more."""
    seen = np.flatnonzero(confidence >= least)
    return bl_weights(cov, market, np.eye(len(cov))[seen], score[seen], confidence[seen], tilt=tilt, **rest)


def mean_variance(mu, cov, previous=None, aversion=2.5, cost=0.0, low=0.0, high=1.0, rounds=20_000, close=1e-12) -> np.ndarray:
    """max mu'w - aversion/2 w'Sw - cost |w - previous|, sum 1, box; bounds must leave a book.

    Accelerated proximal gradient, then the linear system of the weights that no bound or kink holds:
    exact once the active set is. Ends when the duality gap is below ``close``.
    """
    n = len(mu)
    previous = np.full(n, 1 / n) if previous is None else previous
    step = 1 / (aversion * np.linalg.eigvalsh(cov)[-1] + 1e-12)
    gradient = lambda w: mu - aversion * cov @ w
    gap = lambda w: duality_gap(w, gradient(w), previous, cost, low, high)
    w = ahead = _prox(previous, previous, 0.0, low, high)
    best, short, t = w, gap(w), 1.0
    for k in range(rounds):
        new = _prox(ahead + step * gradient(ahead), previous, step * cost, low, high)
        if (ahead - new) @ (new - w) > 0:  # overshot: start the momentum anew
            t = 1.0
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (was - 1) / t * (new - w), new
        if k % 25 == 24:
            for x in (w, _free_weights(w, mu, cov, previous, aversion, cost, low, high)):
                if x is not None and gap(x) < short:
                    best, short = x, gap(x)
            if short < close:
                break
    return best


def _free_weights(w, mu, cov, previous, aversion, cost, low, high, near=1e-7):
    """The optimum with the weights at a bound or at their previous value held there; None if it leaves the box."""
    held = np.where(np.abs(w - low) < near, low, np.where(np.abs(w - high) < near, high, np.where((cost > 0) & (np.abs(w - previous) < near), previous, np.nan)))
    free = np.isnan(held)
    k = int(free.sum())
    if not k:
        return None
    fixed = np.where(free, 0.0, held)
    side = np.sign(w - previous)[free] * cost
    a = np.block([[aversion * cov[np.ix_(free, free)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
    b = np.append(mu[free] - side - aversion * (cov @ fixed)[free], 1 - fixed.sum())
    out = fixed.copy()
    out[free] = np.linalg.lstsq(a, b, rcond=None)[0][:k]
    return out if (out >= low - 1e-12).all() and (out <= high + 1e-12).all() and abs(out.sum() - 1) < 1e-12 else None


def trend_filter(x: np.ndarray, w: np.ndarray, damp: float, window: int = 200) -> np.ndarray:
    """Assets below their moving average keep ``damp`` of their weight; 0 switches the filter off.
    Where nothing is left, equal weights."""
    if damp == 0 or len(x) < window:
        return w
    cum = np.cumprod(1 + x, axis=0)
    out = np.where(cum[-1] < cum[-window:].mean(axis=0), w * damp, w)
    return out / out.sum() if out.sum() > 0 else np.full(len(w), 1 / len(w))


def momentum_tilt(x: np.ndarray, w: np.ndarray, strength: float) -> np.ndarray:
    """Half the weights, half equal weights, tilted by the rank of twelve-one momentum."""
    if strength == 0 or len(x) < 252 or len(w) < 2:
        return w
    mom = np.prod(1 + x[-252:-21], axis=0)
    rank = np.array([((mom < m).sum() + ((mom == m).sum() + 1) / 2) / len(mom) for m in mom])
    out = (w / 2 + 0.5 / len(w)) * np.maximum(1 + strength * (rank - 0.5), 0)
    return out / out.sum() if out.sum() > 0 else out


def sleeve_floor(w: np.ndarray, equity: np.ndarray, floor: float, spare: float = 0.01) -> np.ndarray:
    """Lift the equity sleeve to its floor at the cost of the rest; unchanged where the rest cannot
    pay for it and keep ``spare``."""
    have, other = w[equity].sum(), w[~equity].sum()
    short = floor - have
    if short <= 0 or not equity.any() or other < short + spare:
        return w
    lift = w / have if have > 0 else np.full(len(w), 1 / equity.sum())
    out = np.where(equity, w + short * lift, w * (other - short) / other)
    return out / out.sum()


def regime_band(w: np.ndarray, equity: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bring the equity sleeve into its band; the other sleeve takes the rest, cash if it is empty."""
    have, other = w[equity].sum(), w[~equity].sum()
    goal = min(max(have, low), high)
    if abs(goal - have) < 1e-12:
        return w
    inside = w * (goal / have) if have > 0 else np.full(len(w), goal / max(1, equity.sum()))
    outside = w * ((1 - goal) / other) if other > 0 else np.zeros(len(w))
    return np.where(equity, inside, outside)


def vol_target(x: np.ndarray, w: np.ndarray, target: float, cap: float, window: int = 63) -> np.ndarray:
    sd = (x[-window:] @ w).std(ddof=1) * np.sqrt(252)
    return w * (min(target / sd, cap) if sd > 0 else 1.0)


def no_trade_band(weights: list[np.ndarray], band: float) -> list[np.ndarray]:
    """Keep the last traded weights while the sum of absolute changes stays below the band."""
    out: list[np.ndarray] = []
    for w in weights:
        out.append(w if not out or np.abs(w - out[-1]).sum() >= band else out[-1])
    return out


def historical_cvar(r: np.ndarray, confidence: float = 0.95) -> tuple[float, np.ndarray]:
    """(loss, which rows): mean of the returns at or beyond the historical quantile, lower rank."""
    if not len(r):
        return 0.0, np.zeros(0, bool)
    var = max(0.0, -np.sort(r)[int((len(r) - 1) * (1 - confidence))])
    tail = r <= -var
    return (max(var, -r[tail].mean()) if tail.any() else var), tail


def risk_filter(
    x: np.ndarray, w: np.ndarray, limit: float, confidence: float = 0.95, drawdown_limit: float = 0.2, step: float = 0.1, least: float = 0.0
) -> np.ndarray:
    """Cut the asset with the largest CVaR share by a tenth, down to ``least``, and bring the book back
    to 1, until the CVaR meets its limit; then scale down by the drawdown of the last 504 rows, the
    rest being cash. Fewer than 20 rows say nothing: the weights stay."""
    if len(x) < 20:
        return w.copy()
    w = w.astype(float).copy()
    loss, tail = historical_cvar(x @ w, confidence)
    for _ in range(50 * len(w)):
        if loss <= limit or (w <= least + 1e-10).all():
            break
        worst = np.argmax(-w * x[tail].mean(axis=0) if tail.any() else w)
        w[worst] = max(w[worst] * (1 - step), least)
        w = w / w.sum() if w.sum() > 0 else w
        loss, tail = historical_cvar(x @ w, confidence)
    nav = np.cumprod(1 + x[-504:] @ w)
    drop = ((np.maximum.accumulate(nav) - nav) / np.maximum(np.maximum.accumulate(nav), 1e-10)).max()
    return w * drawdown_limit / drop if drop > drawdown_limit else w


def chain(first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, float]:
    """Row vectors first, first S1, first S1 S2, ..., each scaled to 1, and the log of the last one's sum.

    Products within blocks of about sqrt(T) steps run side by side, then the blocks are linked.
    """
    t, n = len(steps), len(first)
    size = max(1, int(np.ceil(t**0.5)))
    blocks = -(-t // size)
    m = np.concatenate([steps, np.tile(np.eye(n), (blocks * size - t, 1, 1))]).reshape(blocks, size, n, n)
    p, scale = np.empty_like(m), np.empty((blocks, size))
    for j in range(size):
        now = m[:, 0] if j == 0 else p[:, j - 1] @ m[:, j]
        scale[:, j] = now.sum(axis=(1, 2))
        p[:, j] = now / scale[:, j, None, None]
    v, total, starts = first / first.sum(), float(np.log(first.sum()) + np.log(scale).sum()), np.empty((blocks, n))
    for b in range(blocks):
        starts[b] = v
        v = v @ p[b, -1]
        total += float(np.log(v.sum()))
        v = v / v.sum()
    rows = np.einsum("bs,bksr->bkr", starts, p).reshape(-1, n)[:t]
    return np.vstack([first / first.sum(), rows / rows.sum(axis=1, keepdims=True)]), total


def student_hmm(x: np.ndarray, states: int = 3, df: float = 5.0, sticky: float = 8.0, seed: int = 0, rounds: int = 60, close: float = 1e-6):
    """(posterior, log-likelihood, means): EM for a sticky Student-t hidden Markov model, diagonal scales.

    Ends when a round adds less than ``close`` of the likelihood, after ``rounds`` at the latest.
    """
    if not np.isfinite(x).all():
        raise ValueError("state variables must be complete")
    rng = np.random.default_rng(seed)
    t, d = x.shape
    mean, var = x[rng.choice(t, states, False)].astype(float), np.tile(x.var(axis=0) + 1e-6, (states, 1))
    trans, start = (np.eye(states) * sticky + 1) / (sticky + states), np.full(states, 1 / states)
    before = -np.inf
    for _ in range(rounds):
        dist = ((x[:, None] - mean) ** 2 / var).sum(axis=2)
        logp = -0.5 * np.log(var).sum(axis=1) - (df + d) / 2 * np.log1p(dist / df)
        top = logp.max(axis=1, keepdims=True)
        b = np.exp(logp - top)
        a, total = chain(start * b[0], trans * b[1:, None, :])
        back = chain(np.ones(states), (b[1:, :, None] * trans.T)[::-1])[0][::-1]
        post = a * back
        post /= post.sum(axis=1, keepdims=True)
        ahead = b[1:] * back[1:]
        pair = ((a[:-1] @ trans) * ahead).sum(axis=1, keepdims=True)
        xi = trans * (a[:-1].T @ (ahead / pair))
        u = post * (df + d) / (df + dist)
        mean = (u.T @ x) / u.sum(axis=0)[:, None]
        var = np.stack([(u[:, k, None] * (x - mean[k]) ** 2).sum(axis=0) for k in range(states)]) / post.sum(axis=0)[:, None] + 1e-6
        trans = xi + sticky * np.eye(states) + 1e-3
        trans /= trans.sum(axis=1, keepdims=True)
        start = post[0]
        score = total + float(top.sum())
        if score - before < close * abs(score):
            break
        before = score
    return post, score, mean


def cpcv_splits(n: int, groups: int, test_groups: int, label_end: np.ndarray, embargo: int):
    """(test rows, train rows) of combinatorial purged cross-validation: train rows whose label ends
    inside a test segment, and ``embargo`` rows after one, are left out."""
    parts = np.array_split(np.arange(n), groups)
    for chosen in combinations(range(groups), test_groups):
        test = np.concatenate([parts[g] for g in chosen])
        keep = np.ones(n, bool)
        keep[test] = False
        for g in chosen:
            lo, hi = parts[g][0], parts[g][-1]
            keep &= ~((label_end >= lo) & (label_end <= hi))
            keep[hi + 1 : hi + 1 + embargo] = False
        yield test, np.flatnonzero(keep)


def stationary_blocks(t: int, reps: int, seed: int = 42, p: float | None = None):
    """(starts, sizes) of the blocks of each draw of the stationary bootstrap, one stream of random
    numbers for all: geometric lengths, 1 / sqrt(T) a step unless ``p`` is given. The order of the
    random numbers is fixed, so that intervals can be compared."""
    rng = np.random.default_rng(seed)
    p = 1 / max(1.0, t**0.5) if p is None else p
    for _ in range(reps):
        blocks = max(1, int(t * p * 3))
        starts, sizes = list(rng.integers(0, t, size=blocks)), list(rng.geometric(p, size=blocks))
        while sum(sizes) < t:
            starts.append(int(rng.integers(0, t)))
            sizes.append(int(rng.geometric(p)))
        yield np.array(starts, np.int64), np.array(sizes, np.int64)


def stationary_bootstrap(t: int, reps: int, seed: int = 42, p: float | None = None):
    """Index rows of the draws: the blocks one after the other, wrapping around, up to T rows."""
    for starts, sizes in stationary_blocks(t, reps, seed, p):
        stop = np.cumsum(sizes)
        yield ((np.repeat(starts - stop + sizes, sizes) + np.arange(stop[-1])) % t)[:t]


def expanding_quantiles(x: np.ndarray, probs: tuple[float, ...]) -> np.ndarray:
    """Linear quantiles of x[: i + 1] for every i, a column for each of ``probs``; x has no gaps.

    A wavelet matrix over the ranks: each of its log2(n) levels halves the values that a prefix's
    order statistic can have, for all prefixes at once, so the work is n log n.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    code = np.empty(n, np.int64)
    code[order] = np.arange(n)
    at = np.arange(n)[:, None] * np.asarray(probs)
    low = np.floor(at + 1e-12).astype(np.int64)
    k = np.concatenate([low, np.minimum(low + 1, np.arange(n)[:, None])], axis=1)
    left, right = np.zeros_like(k), np.broadcast_to(np.arange(1, n + 1)[:, None], k.shape).copy()
    found = np.zeros_like(k)
    for bit in reversed(range(max(1, int(n - 1).bit_length()))):
        one = code >> bit & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        a, b = zeros[left], zeros[right]
        go = k >= b - a  # to the upper half
        k = np.where(go, k - (b - a), k)
        left, right = np.where(go, zeros[-1] + left - a, a), np.where(go, zeros[-1] + right - b, b)
        found |= go.astype(np.int64) << bit
        code = np.concatenate((code[one == 0], code[one == 1]))
    value = x[order][found]
    lower, upper = value[:, : len(probs)], value[:, len(probs) :]
    return lower + (upper - lower) * (at - low)


def track_record(r: np.ndarray, periods: int = 252) -> dict[str, float]:
    """Sharpe and Sortino ratios, compound growth, drawdown and Calmar ratio of a return series."""
    sd, bad = r.std(ddof=1), r[r < 0]
    down = bad.std(ddof=1) if len(bad) > 1 else np.nan if len(bad) else 0.0
    nav = np.cumprod(1 + r)
    drop = float(((np.maximum.accumulate(nav) - nav) / np.maximum.accumulate(nav)).max())
    growth = float(nav[-1] ** (periods / len(r)) - 1)
    return {
        "sharpe": float(r.mean() / sd * periods**0.5) if sd else 0.0, "sortino": float(r.mean() / down * periods**0.5) if down else float("inf"),
        "cagr": growth, "max_dd": drop, "calmar": growth / drop if drop else float("inf"),
    }


def bootstrap_intervals(r: np.ndarray, reps: int = 1000, confidence: float = 0.95, seed: int = 42, p: float | None = None) -> dict[str, tuple[float, float, float]]:
    """Metric -> (point, low, high), linear quantiles of the resampled metrics."""
    if not len(r) or np.isnan(r).any():
        raise ValueError("needs returns without gaps")
    point = track_record(r)
    drawn = [track_record(r[ix]) for ix in stationary_bootstrap(len(r), reps, seed, p)]
    side = (1 - confidence) / 2
    return {m: (v, *(float(np.quantile([d[m] for d in drawn], q)) for q in (side, 1 - side))) for m, v in point.items()}
