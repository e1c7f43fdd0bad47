"""Dense reference fits in numpy: explicit dummies, sandwich errors."""

import numpy as np
import pandas as pd


def dummies(values, drop_first=True):
    levels = sorted(set(values))
    if drop_first:
        levels = levels[1:]
    return np.array([[float(v == level) for level in levels] for v in values]).reshape(len(values), len(levels))


def design(pdf, x, cats=("dow", "month_year"), unit_effects=True):
    parts = [np.ones((len(pdf), 1))]
    parts += [dummies(list(pdf[c])) for c in cats]
    if unit_effects:
        parts.append(dummies(list(pdf["unit"])))
    parts.append(pdf[list(x)].to_numpy(dtype=float))
    return np.hstack(parts)


def clustered_ols(pdf, y, x, cats=("dow", "month_year"), unit_effects=True, k=None):
    """Coefficients, errors and R2 of the last len(x) columns, by pseudo-inverse."""
    z = design(pdf, x, cats, unit_effects)
    target = pdf[y].to_numpy(dtype=float)
    inverse = np.linalg.pinv(z.T @ z, rcond=1e-10)
    beta = inverse @ z.T @ target
    e = target - z @ beta
    units = pdf["unit"].to_numpy()
    meat = np.zeros((z.shape[1], z.shape[1]))
    for u in pd.unique(units):
        s = z[units == u].T @ e[units == u]
        meat += np.outer(s, s)
    n, g = len(pdf), len(pd.unique(units))
    k = k if k is not None else z.shape[1]
    cov = g / (g - 1) * (n - 1) / (n - k) * inverse @ meat @ inverse
    r2 = 1 - (e @ e) / ((target - target.mean()) ** 2).sum()
    m = len(x)
    return beta[-m:], np.sqrt(np.diag(cov)[-m:]), r2


def count_fit(pdf, y, x, a=None, cats=(), rounds=200):
    """NB2 (a is estimated) or Poisson (a = 0) by Newton on all parameters."""
    import math

    z = design(pdf, x, cats, True)
    target = pdf[y].to_numpy(dtype=float)
    lg = np.vectorize(math.lgamma)

    def loglik(theta, a):
        mu = np.exp(z @ theta)
        if a == 0:
            return (target * np.log(mu) - mu - lg(target + 1)).sum()
        t = 1 / a
        return (
            lg(target + t) - lg(t) - lg(target + 1) + t * np.log(t / (t + mu)) + target * np.log(mu / (t + mu))
        ).sum()

    def slopes(a, theta):
        for _ in range(rounds):
            mu = np.exp(z @ theta)
            s = (target - mu) / (1 + a * mu)
            w = mu * (1 + a * target) / (1 + a * mu) ** 2
            step = np.linalg.solve(z.T @ (z * w[:, None]), z.T @ s)
            theta = theta + step * min(1.0, 2.0 / np.abs(step).max())
            if np.abs(step).max() < 1e-11:
                break
        return theta

    theta = np.zeros(z.shape[1])
    theta[0] = np.log(target.mean())
    theta = slopes(0.0, theta)
    if a == 0.0:
        mu = np.exp(z @ theta)
        cov = np.linalg.inv(z.T @ (z * mu[:, None]))
        return theta[-len(x):], np.sqrt(np.diag(cov))[-len(x):], 0.0, loglik(theta, 0.0)
    low, high = -8.0, 3.0  # golden section in log(a)
    ratio = (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        if loglik(slopes(math.exp(c), theta), math.exp(c)) > loglik(slopes(math.exp(d), theta), math.exp(d)):
            high = d
        else:
            low = c
    a = math.exp((low + high) / 2)
    theta = slopes(a, theta)
    # joint observed information by differences of the gradient in (theta, a)
    h = 1e-5

    def grad(v):
        t, b = v[:-1], v[-1]
        mu = np.exp(z @ t)
        g_a = (loglik(t, b * (1 + 1e-5)) - loglik(t, b * (1 - 1e-5))) / (2e-5 * b)
        return np.append(z.T @ ((target - mu) / (1 + b * mu)), g_a)

    v = np.append(theta, a)
    info = np.zeros((len(v), len(v)))
    for i in range(len(v)):
        up, down = v.copy(), v.copy()
        up[i] += h
        down[i] -= h
        info[i] = -(grad(up) - grad(down)) / (2 * h)
    cov = np.linalg.inv((info + info.T) / 2)
    m = len(x)
    return theta[-m:], np.sqrt(np.diag(cov))[-m - 1 : -1], a, loglik(theta, a)
