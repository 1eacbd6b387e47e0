"""Largest eigenpairs of a symmetric matrix that is known by its products alone.

A Jacobi-Davidson iteration on a block: Rayleigh-Ritz over a growing subspace
gives approximate eigenpairs; for each that is not exact yet, a correction comes
from the equation ``(I - QQ')(A - theta I)(I - QQ') t = -r``, with ``Q`` the locked
and the present vectors, solved to some depth by MINRES; corrections join the
subspace. Pairs whose residual reaches double precision are locked, and the others
go on orthogonally to them. All equations take their MINRES steps together, so a
step is one product with a block of vectors.

Vectors are small here (the dimension of the space); the products may come from
any number of machines.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]

EPS = np.finfo(np.float64).eps
#: A residual of so many units of rounding of the largest eigenvalue is double precision.
TOLERANCE = 16.0
#: A pair that stops improving is taken from so many units on: products round, too.
SETTLED = 512.0
MAX_ROUNDS = 200


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The block's columns made orthonormal and orthogonal to ``against``; dependent ones fall away."""
    kept = np.empty((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for fixed in (against, kept):
                column = column - fixed @ (fixed.T @ column)
            length = np.linalg.norm(column)
            if length < 1e-8:
                break
            column = column / length
        else:
            kept = np.column_stack([kept, column])
    return kept


def minres(product: Product, shifts: np.ndarray, project: Callable, right: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """MINRES on ``project (A - shift I) project x = right``, a system a column, ``steps`` steps at most.

    Three-term Lanczos vectors and one Givens rotation a step, each done for all
    systems at once; a system that has met ``goal`` times its right side, or whose
    Krylov space ends, stands still.
    """
    n = right.shape[1]
    x, v_old, w_old, w = (np.zeros_like(right) for _ in range(4))
    beta = np.linalg.norm(right, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v = right / start
    eta, live = beta.copy(), beta > 0
    gamma_old, gamma, sigma_old, sigma = np.ones(n), np.ones(n), np.zeros(n), np.zeros(n)
    beta_now = np.zeros(n)
    for _ in range(steps):
        at = np.flatnonzero(live)
        if not len(at):
            break
        image = np.zeros_like(right)
        image[:, at] = project(product(v[:, at]) - v[:, at] * shifts[at], at)
        alpha = np.einsum("ij,ij->j", v, image)
        v_new = image - v * alpha - v_old * beta_now
        beta_next = np.linalg.norm(v_new, axis=0)
        delta = gamma * alpha - gamma_old * sigma * beta_now
        rho1 = np.hypot(delta, beta_next)
        rho2 = sigma * alpha + gamma_old * gamma * beta_now
        rho3 = sigma_old * beta_now
        safe = np.where(rho1 > 0, rho1, 1.0)
        gamma_old, gamma, sigma_old, sigma = gamma, delta / safe, sigma, beta_next / safe
        w_new = (v - w_old * rho3 - w * rho2) / safe
        step = np.where(live & (rho1 > 0), gamma * eta, 0.0)
        x = x + w_new * step
        eta = -sigma * eta
        v_old, v = v, v_new / np.where(beta_next > 0, beta_next, 1.0)
        w_old, w, beta_now = w, w_new, beta_next
        live = live & (rho1 > 0) & (np.abs(eta) > goal * start) & (beta_next > 8 * EPS * np.abs(shifts))
    return x


def largest_eigenpairs(
    product: Product, size: int, count: int, seed: int = 0, depth: int = 4, max_space: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the ``count`` largest.

    Every vector's largest entry is positive. ``depth`` is the number of MINRES
    steps of a correction; beyond ``max_space`` vectors the subspace is restarted
    from its best ones.
    """
    count = min(count, size)
    # Subspace dimension from which the whole space is no larger: take it at once.
    room = max_space or 4 * count
    width = size if size <= room else min(size, count + 4)
    locked, values = np.empty((size, 0)), np.empty(0)
    start = np.eye(size)[:, :width] if width == size else np.random.default_rng(seed).standard_normal((size, width))
    space = orthonormal(start, locked)
    images = product(space)
    best = np.full(count, np.inf)
    scale = 0.0
    for _ in range(MAX_ROUNDS):
        small = space.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        wanted = min(count - len(values), len(theta))
        ritz, ritz_images = space @ turn, images @ turn
        scale = max(scale, np.abs(theta).max(initial=0.0), np.abs(values).max(initial=0.0))
        residual = ritz_images[:, :wanted] - ritz[:, :wanted] * theta[:wanted]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        known = best[len(values) : len(values) + wanted]
        settled = (norms <= SETTLED * EPS * scale) & (norms > known / 2)
        best[len(values) : len(values) + wanted] = np.minimum(known, norms)
        done = (norms <= TOLERANCE * EPS * scale) | settled
        # Lock from the largest on, so that none that is still to appear is passed over.
        n_done = wanted if done.all() else int(np.argmin(done))
        whole = space.shape[1] + len(values) == size
        if whole:
            n_done = wanted
        if n_done:
            locked = np.column_stack([locked, ritz[:, :n_done]])
            values = np.append(values, theta[:n_done])
            ritz, ritz_images, theta = ritz[:, n_done:], ritz_images[:, n_done:], theta[n_done:]
            residual, norms = residual[:, n_done:], norms[n_done:]
            if len(values) == count:
                break
        going = np.flatnonzero(norms > TOLERANCE * EPS * scale)
        fixed = np.column_stack([locked, ritz[:, : residual.shape[1]]])
        project = lambda block, _at: block - fixed @ (fixed.T @ block)
        right = project(-residual[:, going], going)
        steps = minres(product, theta[going], project, right, depth, 1e-3)
        space, images = ritz, ritz_images
        if space.shape[1] + len(going) > room:
            keep = max(residual.shape[1] + 4, room - len(going) - count)
            space, images = space[:, :keep], images[:, :keep]
        fresh = orthonormal(project(steps, going), np.column_stack([locked, space]))
        if not fresh.shape[1]:  # nothing new to be had from the equations
            fresh = orthonormal(np.random.default_rng(len(values)).standard_normal((size, 1)), np.column_stack([locked, space]))
        if fresh.shape[1]:
            space, images = np.column_stack([space, fresh]), np.column_stack([images, product(fresh)])
    else:
        raise ArithmeticError("eigenpairs did not reach double precision")
    order = np.argsort(-values, kind="stable")
    values, locked = values[order], locked[:, order]
    signs = np.sign(locked[np.abs(locked).argmax(axis=0), np.arange(count)])
    return values, locked * np.where(signs == 0, 1, signs)
