"""Small dense solvers that run inside one task, on one p x p matrix.

They receive sufficient statistics, never samples. Spark decides which
statistics go to which task.
"""

from __future__ import annotations

import numpy as np


def lasso_nodes(g: np.ndarray, lam: float, nodes: np.ndarray, max_iter: int = 10_000,
                tol: float = 1e-12) -> np.ndarray:
    """Lasso of each listed variable on all others, from the Gram matrix ``g``.

    Minimises ``b'gb/2 - g_i'b + lam*|b|_1`` with ``b_i = 0`` for every node at
    once: one sweep updates coordinate j of all the regressions together.
    """
    p = g.shape[0]
    m = len(nodes)
    beta = np.zeros((m, p))
    grad = g[nodes].copy()  # g_i - G b, kept current
    diag = np.diag(g).copy()
    own = np.full(p, -1)
    own[nodes] = np.arange(m)
    live = np.arange(m)
    usable = np.flatnonzero(diag > 0)
    for _ in range(max_iter):
        b, r = beta[live], grad[live]
        pos = np.full(m, -1)
        pos[live] = np.arange(len(live))
        worst = np.zeros(len(live))
        for j in usable:
            u = r[:, j] + diag[j] * b[:, j]
            new = np.sign(u) * np.maximum(np.abs(u) - lam, 0.0) / diag[j]
            k = own[j]
            if k >= 0 and pos[k] >= 0:
                new[pos[k]] = 0.0
            step = new - b[:, j]
            moved = np.flatnonzero(step)
            if moved.size:
                b[moved, j] = new[moved]
                r[moved] -= step[moved, None] * g[j]
                np.maximum.at(worst, moved, np.abs(step[moved]) * np.sqrt(diag[j]))
        beta[live], grad[live] = b, r
        live = live[worst > tol]
        if live.size == 0:
            break
    return beta


def residual_variance(g: np.ndarray, nodes: np.ndarray, beta: np.ndarray) -> np.ndarray:
    cross = np.einsum("mp,mp->m", beta, g[nodes])
    quad = np.einsum("mp,mp->m", beta @ g, beta)
    return np.maximum(g[nodes, nodes] - 2.0 * cross + quad, 0.0)


def nodewise_precision(g: np.ndarray, n: int, lam: float, max_iter: int, tol: float,
                       dof: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Symmetrised de-sparsified precision and variance for one dense Gram matrix."""
    p = g.shape[0]
    nodes = np.arange(p)
    beta = lasso_nodes(g, lam, nodes, max_iter, tol)
    tau2 = residual_variance(g, nodes, beta)
    positive = tau2[tau2 > 0]
    floor = max(1e-6 * positive.mean(), 1e-8) if positive.size else 1e-8
    tau2 = np.maximum(tau2, floor)
    half = -beta / tau2[:, None]
    omega = (half + half.T) / 2.0
    if dof:
        df = np.maximum(n - (beta != 0).sum(axis=1), 1.0)
        omega = omega * n / ((df[:, None] + df[None, :]) / 2.0)
    np.fill_diagonal(omega, 0.0)
    return omega, np.outer(tau2, tau2)


def soft(a: np.ndarray, t) -> np.ndarray:
    return np.sign(a) * np.maximum(np.abs(a) - t, 0.0)


def admm_glasso(s: np.ndarray, lam: float, mask: np.ndarray | None = None,
                start: tuple[np.ndarray, np.ndarray] | None = None, max_iter: int = 500,
                tol: float = 1e-5, rtol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, bool]:
    """Graphical lasso by ADMM (Boyd et al. 2011), off-diagonal penalty only.

    ``start`` is a pair (matrix, multiplier) of a neighbouring problem. Returns
    the sparse iterate, the unscaled multiplier and whether the residual test
    was met. The step size follows residual balancing.
    """
    p = s.shape[0]
    weight = lam * (mask if mask is not None else 1.0) * (1.0 - np.eye(p))
    theta, dual = (np.eye(p), np.zeros((p, p))) if start is None else (start[0].copy(), start[1].copy())
    rho = 1.0
    for _ in range(max_iter):
        d, v = np.linalg.eigh(theta - dual - s / rho)
        omega = (v * ((d + np.sqrt(d * d + 4.0 / rho)) / 2.0)) @ v.T
        previous = theta
        theta = soft(omega + dual, weight / rho)
        dual = dual + omega - theta
        primal = np.linalg.norm(omega - theta)
        shift = rho * np.linalg.norm(theta - previous)
        eps_p = p * tol + rtol * max(np.linalg.norm(omega), np.linalg.norm(theta))
        eps_d = p * tol + rtol * rho * np.linalg.norm(dual)
        if primal <= eps_p and shift <= eps_d:
            return theta, rho * dual, True
        if primal > 10.0 * shift:
            rho, dual = rho * 2.0, dual / 2.0
        elif shift > 10.0 * primal:
            rho, dual = rho / 2.0, dual * 2.0
    return theta, rho * dual, False


def components_of(adj: np.ndarray) -> np.ndarray:
    """Connected-component label of every node of a dense boolean matrix."""
    p = adj.shape[0]
    label = np.full(p, -1)
    for s in range(p):
        if label[s] >= 0:
            continue
        front = np.zeros(p, bool)
        front[s] = True
        label[s] = s
        while front.any():
            front = adj[front].any(axis=0) & (label < 0)
            label[front] = s
    return label


def glasso(s: np.ndarray, lam: float, mask: np.ndarray | None = None,
           start: tuple[np.ndarray, np.ndarray] | None = None, max_iter: int = 2000,
           tol: float = 1e-8, rtol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, bool]:
    """Graphical lasso, solved per block of the screened covariance.

    Variables that are not connected by ``|s_ij| > lam * mask_ij`` have an
    exactly block-diagonal solution (Mazumder and Hastie 2012), so each block
    is solved by itself and isolated variables in closed form. Returns the
    precision, the multiplier (a warm start) and convergence of every block.
    """
    p = s.shape[0]
    linked = np.abs(s) > lam * (mask if mask is not None else 1.0)
    np.fill_diagonal(linked, False)
    label = components_of(linked)
    out, dual, good = np.zeros((p, p)), np.zeros((p, p)), True
    for c in np.unique(label):
        idx = np.flatnonzero(label == c)
        if len(idx) == 1:
            k = idx[0]
            out[k, k] = 1.0 / s[k, k] if s[k, k] > 0 else 0.0
            continue
        block = np.ix_(idx, idx)
        theta, u, ok = admm_glasso(
            s[block], lam, None if mask is None else mask[block],
            None if start is None else (start[0][block], start[1][block]), max_iter, tol, rtol)
        out[block], dual[block] = (theta + theta.T) / 2.0, u
        good = good and ok
    return out, dual, good


def gaussian_score(cov: np.ndarray, precision: np.ndarray) -> float:
    """Average Gaussian log-likelihood of a covariance under a precision matrix."""
    sign, logdet = np.linalg.slogdet(precision)
    if sign <= 0:
        return float("-inf")
    p = cov.shape[0]
    return float((logdet - (cov * precision).sum() - p * np.log(2.0 * np.pi)) / 2.0)
