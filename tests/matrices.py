"""Small matrices with known results."""

import numpy as np

TINY = np.array([[1, 1, 0, 0], [1, 1, 1, 0], [0, 1, 1, 0], [1, 0, 1, 1], [0, 1, 0, 1], [1, 1, 0, 1]], float)
THREE_A = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]], float)
THREE_B = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1], [1, 0, 0]], float)


def small_norm():
    x = np.zeros((10, 3))
    x[:3, 0], x[:, 1], x[5:, 2] = 1, 1, 1
    return x


def ill_conditioned():
    x = np.zeros((60, 4))
    x[:50, 0], x[:50, 1], x[:40, 2], x[10:30, 3] = 1, 1, 1, 1
    return x


def violation(x, w, lambd, beta):
    """Largest slope by which some weight could still improve the objective, from central differences of the objective itself.

    The objective is quadratic in one weight, so differences are exact but for rounding; a weight of zero may only rise.
    """
    h, worst = 1e-3, 0.0

    def cost(i, column):
        off = x[:, i] - x @ column
        return off @ off / 2 + lambd * column.sum() + beta / 2 * column @ column

    for i in range(x.shape[1]):
        for k in range(x.shape[1]):
            if k != i:
                up, down = w[:, i].copy(), w[:, i].copy()
                up[k] += h
                down[k] -= h
                slope = (cost(i, up) - cost(i, down)) / (2 * h)
                worst = max(worst, abs(slope) if w[k, i] > 0 else -slope)
    return worst
