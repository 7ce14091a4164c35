"""Numeric cores of the per-series models: a filter through gaps, and smoothing parameters fitted side by side (numpy only)."""
import numpy as np

RING = 49  # a value needs its 1st, 48th and 49th predecessor


def filter_through_gaps(values, origins, coefficients, noise, prior, horizon: int, first=None):
    """Forecasts (origin, lead) of y(t) = a y(t-1) + b y(t-48) + c y(t-49) + e at each origin, given all values before it.

    The state is the last 49 values. Their means and covariances live in a ring, slot t mod 49, so a new value replaces
    the one that is no longer needed and a step costs one row of the covariance; only an observed value that says
    something about missing ones touches the rest. An origin starts behind its last 49 known values in a row, where
    nothing is uncertain, or else at its ``first`` row with independent values of mean 0 and variance ``prior``. Origins
    are given in rising order; their stretches overlap in time, so those under way are one slice and step together.
    """
    values, origins = np.asarray(values, float), np.asarray(origins, int)
    count, known = len(origins), np.isfinite(values)
    first = np.zeros(count, int) if first is None else np.asarray(first, int)
    run = np.zeros(len(values) + 1, int)  # known values in a row up to a place
    for t, k in enumerate(known):
        run[t + 1] = run[t] + 1 if k else 0
    full = np.where(run >= RING, np.arange(len(run)), -1)
    full = np.maximum.accumulate(full)[origins]
    certain = full - RING >= first
    begin = np.where(certain, full, first)
    begin = np.minimum.accumulate(begin[::-1])[::-1]  # one slice at any time; an earlier start changes no result
    a, b, c = (np.asarray(coefficients, float)[:, i:i + 1] for i in range(3))
    noise, prior = np.asarray(noise, float), np.asarray(prior, float)
    mean, cover = np.zeros((count, RING)), np.zeros((count, RING, RING))
    for i in range(count):
        past = np.arange(begin[i] - RING, begin[i])
        seen = (past >= first[i]) & (past >= 0)
        seen[seen] = known[past[seen]]
        mean[i, past[seen] % RING] = values[past[seen]]
        open_slots = past[~seen] % RING
        cover[i, open_slots, open_slots] = prior[i]
    for t in range(begin.min(initial=0), origins.max(initial=0)):
        lo, hi = np.searchsorted(origins, t, "right"), np.searchsorted(begin, t, "right")
        if lo >= hi:
            continue
        m, p, at = mean[lo:hi], cover[lo:hi], slice(lo, hi)
        s, s1, s48 = t % RING, (t - 1) % RING, (t - 48) % RING
        guess = a[at, 0] * m[:, s1] + b[at, 0] * m[:, s48] + c[at, 0] * m[:, s]
        row = a[at] * p[:, s1] + b[at] * p[:, s48] + c[at] * p[:, s]
        spread = a[at, 0] * row[:, s1] + b[at, 0] * row[:, s48] + c[at, 0] * row[:, s] + noise[at]
        p[:, s], p[:, :, s], p[:, s, s] = row, row, spread
        m[:, s] = guess
        if t < len(values) and known[t]:
            gain = np.divide(p[:, s], spread[:, None], out=np.zeros_like(row), where=spread[:, None] > 0)
            away = np.delete(row, s, 1)
            if np.abs(away).max(initial=0) > 0:
                m += gain * (values[t] - guess)[:, None]
                p -= gain[:, :, None] * p[:, s][:, None, :].copy()
            m[:, s] = values[t]
            p[:, s], p[:, :, s] = 0.0, 0.0
    out = np.empty((count, horizon))
    for i, o in enumerate(origins):
        ring = mean[i].copy()
        for lead in range(horizon):
            t = o + lead
            out[i, lead] = ring[t % RING] = a[i, 0] * ring[(t - 1) % RING] + b[i, 0] * ring[(t - 48) % RING] + c[i, 0] * ring[t % RING]
    return out


# --- additive smoothing ---

LEAST = 1e-4
EDGE = 1e-9   # a parameter this close to its bound is at it


def parameters(u, damped: bool):
    """alpha, beta, gamma, phi of points in the unit box: beta is a share of alpha, gamma a share of 1 - alpha."""
    alpha = LEAST + (1 - 2 * LEAST) * u[:, 0]
    phi = 0.8 + 0.18 * u[:, 3] if damped else None
    return alpha, alpha * u[:, 1], (1 - alpha) * u[:, 2], phi


def box_point(alpha, beta, gamma, phi=0.98):
    """Inverse of :func:`parameters` for one set of parameters."""
    return np.clip([(alpha - LEAST) / (1 - 2 * LEAST), beta / alpha, gamma / (1 - alpha), (phi - 0.8) / 0.18], 0, 1)


def smooth(y, season, alpha, beta, gamma, phi, stops, slopes=None):
    """One pass of additive smoothing for many parameter sets, each over the first ``stops`` rows (rising) of ``y``.

    Returns the squared error and the state (level, trend, seasonal) behind each set's last row; with ``slopes``, an
    array (set, parameter, 4) of derivatives of (alpha, beta, gamma, phi), also the sums e' e and e' e'' of the errors'
    derivatives by those parameters, carried along in the same pass. Sets whose rows are done leave the moving slice.
    """
    count, trended = len(stops), phi is not None
    phi = np.zeros(count) if phi is None else phi
    level = np.full(count, y[:season].mean())
    trend = np.full(count, (y[season:2 * season].mean() - y[:season].mean()) / season if trended else 0.0)
    seasonal = np.tile(y[:season] - y[:season].mean(), (count, 1))
    error = np.zeros(count)
    k = 0 if slopes is None else slopes.shape[1]
    d_level, d_trend, d_seasonal = np.zeros((count, k)), np.zeros((count, k)), np.zeros((count, season, k))
    first, second = np.zeros((count, k)), np.zeros((count, k, k))
    for t in range(season, int(stops.max(initial=season))):
        lo, at = int(np.searchsorted(stops, t, "right")), t % season
        l, b, s = level[lo:], trend[lo:], seasonal[lo:, at]
        base = l + phi[lo:] * b
        e = y[t] - base - s
        error[lo:] += e * e
        if k:
            dl, db, ds = d_level[lo:], d_trend[lo:], d_seasonal[lo:, at]
            d_alpha, d_beta, d_gamma, d_phi = (slopes[lo:, :, i] for i in range(4))
            d_base = dl + phi[lo:, None] * db + d_phi * b[:, None]
            de = -d_base - ds
            first[lo:] += de * e[:, None]
            second[lo:] += de[:, :, None] * de[:, None, :]
            d_trend[lo:] = phi[lo:, None] * db + d_phi * b[:, None] + d_beta * e[:, None] + beta[lo:, None] * de
            d_level[lo:] = d_base + d_alpha * e[:, None] + alpha[lo:, None] * de
            d_seasonal[lo:, at] = ds + d_gamma * e[:, None] + gamma[lo:, None] * de
        level[lo:] = base + alpha[lo:] * e
        trend[lo:] = phi[lo:] * b + beta[lo:] * e
        seasonal[lo:, at] = s + gamma[lo:] * e
    return error, (level, trend, seasonal), first, second


def fit_smoothing(y, season, stops, trended: bool, damped: bool, starts: int = 3, rounds: int = 100, tolerance: float = 1e-6):
    """(points, phi, squared errors, converged, states), one per stop: bounded least squares from the best grid points.

    A fixed grid is run once over ``y`` and read at each stop; the ``starts`` best points of every stop then move side by
    side. A step solves the damped normal equations of the free parameters inside the unit box and is taken if the error
    falls. A problem has converged when no free parameter would move by ``tolerance`` under its own curvature, or when
    an accepted step lowers the error by less than a relative 1e-8. The error is never above the grid's.
    """
    stops = np.asarray(sorted(stops), int)
    grid = np.array([box_point(a, b, g) for a in (0.05, 0.1, 0.2, 0.4, 0.7) for b in ((0.0, 0.01, 0.05) if trended else (0.0,))
                     for g in (0.01, 0.05, 0.1, 0.2)])
    free = [0, 2] if not trended else [0, 1, 2, 3] if damped else [0, 1, 2]

    def phis(u):
        return parameters(u, damped)[3] if damped else np.ones(len(u)) if trended else None

    def run(u, ends, slopes=False):
        alpha, beta, gamma, _ = parameters(u, damped)
        turn = None
        if slopes:
            turn = np.zeros((len(u), 4, 4))
            turn[:, 0, 0] = 1 - 2 * LEAST
            turn[:, 0, 1], turn[:, 1, 1] = (1 - 2 * LEAST) * u[:, 1], alpha
            turn[:, 0, 2], turn[:, 2, 2] = -(1 - 2 * LEAST) * u[:, 2], 1 - alpha
            turn[:, 3, 3] = 0.18
            turn = turn[:, free]
        return smooth(y, season, alpha, beta, gamma, phis(u), ends, turn)

    at_stops = np.repeat(stops, len(grid))
    tried = run(np.tile(grid, (len(stops), 1)), at_stops)[0].reshape(len(stops), len(grid))
    best = np.argsort(tried, 1, kind="stable")[:, :starts]
    u, ends = grid[best].reshape(-1, 4), np.repeat(stops, best.shape[1])
    error, _, g, h = run(u, ends, True)
    damping, done = np.full(len(u), 1e-3), np.zeros(len(u), bool)

    def settled(u, g, h, error):
        curve = np.maximum(np.einsum("bii->bi", h), np.finfo(float).tiny)
        return (np.abs(np.clip(u[:, free] - g / curve, 0, 1) - u[:, free]).max(1) <= tolerance) | (error == 0)

    done |= settled(u, g, h, error)
    for _ in range(rounds):
        move = np.flatnonzero(~done)
        if not len(move):
            break
        v = u[move]
        pushed = ((v[:, free] <= EDGE) & (g[move] > 0)) | ((v[:, free] >= 1 - EDGE) & (g[move] < 0))
        m = h[move].copy()
        scale = np.maximum(np.einsum("bii->bi", m), 1e-300)
        m += np.einsum("bi,ij->bij", damping[move, None] * scale, np.eye(len(free)))
        right = np.where(pushed, 0.0, -g[move])
        m = np.where(pushed[:, :, None] | pushed[:, None, :], 0.0, m) + np.einsum("bi,ij->bij", np.where(pushed, 1.0, 0.0), np.eye(len(free)))
        step = (np.linalg.pinv(m, rcond=1e-14, hermitian=True) @ right[:, :, None])[:, :, 0]
        new = v.copy()
        new[:, free] = np.clip(v[:, free] + step, 0, 1)
        e, _, g2, h2 = run(new, ends[move], True)
        better = e < error[move]
        gain = np.where(better, error[move] - e, 0.0)
        took = move[better]
        u[took], g[took], h[took] = new[better], g2[better], h2[better]
        flat = better & (gain <= 1e-8 * error[move])
        error[took] = e[better]
        damping[move] = np.where(better, damping[move] / 5, damping[move] * 5)
        done[move] |= flat
        done |= settled(u, g, h, error)
        # A step so short that it changes no digit cannot lower the error either.
        done[move] |= ~better & (np.abs(step).max(1) <= tolerance ** 2)
    error, done = error.reshape(len(stops), -1), done.reshape(len(stops), -1)
    pick = error.argmin(1)
    rows = np.arange(len(stops))
    chosen = u.reshape(len(stops), -1, 4)[rows, pick]
    _, states, _, _ = run(chosen, stops)
    return chosen, phis(chosen), error[rows, pick], done[rows, pick], states, tried.min(1)
