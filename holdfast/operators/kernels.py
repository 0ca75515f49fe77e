"""The small numpy helpers that run inside tasks, on Arrow batches.

They are pickled by value, so executors need numpy and pandas but not this
package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_BLOCK = 256
CELLS_PER_STEP = 1 << 19


def hazard_terms(batches, k):
    """Log-likelihood, gradient and information summed over chunks of ties.

    A row is one event time and a range [lo, hi) of its d tied events; ``run_*``
    are sums over the risk set and ``t*`` over the tied events. The l-th tied
    event sees the risk set less the share u = l / d of the tie.
    """
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["ll", *[f"u{i}" for i in range(k)], *[f"h{i}_{j}" for i, j in pairs]]
    for batch in batches:
        total = np.zeros(len(names))
        for row in batch.to_dict("records"):
            u = np.arange(row["lo"], row["hi"], dtype="float64") / row["d"]
            left = row["run_s"] - u * row["ts"]
            inv = 1.0 / left
            inv2 = inv * inv
            s1, s1u = inv.sum(), (inv * u).sum()
            s2, s2u, s2uu = inv2.sum(), (inv2 * u).sum(), (inv2 * u * u).sum()
            a = np.array([row[f"run_s{i}"] for i in range(k)])
            b = np.array([row[f"ts{i}"] for i in range(k)])
            fixed = row["lo"] == 0
            own = np.array([row[f"g{i}"] for i in range(k)]) if fixed else np.zeros(k)
            outer = (np.outer(a, a) * s2 - (np.outer(a, b) + np.outer(b, a)) * s2u
                     + np.outer(b, b) * s2uu)
            total += np.array(
                [
                    (row["m"] if fixed else 0.0) - np.log(left).sum(),
                    *(own - (a * s1 - b * s1u)),
                    *[row[f"run_s{i}_{j}"] * s1 - row[f"ts{i}_{j}"] * s1u - outer[i, j]
                      for i, j in pairs],
                ]
            )
        yield pd.DataFrame([total], columns=names)


def hazard_increments(batches, k):
    """What a time's tied events add to every row at risk, over chunks of ties.

    Per chunk: the hazard ``h`` and hazard times mean covariates ``hx*``; the same for
    the tied rows themselves (``th``, ``thx*``), of which the l-th event sees the share
    1 - l / d only; and the tie's mean covariates ``m*``.
    """
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            u = np.arange(row["lo"], row["hi"], dtype="float64") / row["d"]
            inv = 1.0 / (row["run_s"] - u * row["ts"])
            a = np.array([row[f"run_s{i}"] for i in range(k)])
            b = np.array([row[f"ts{i}"] for i in range(k)])
            means = (a[:, None] - b[:, None] * u) * inv
            out.append([row["time"], inv.sum(), *(means @ inv), ((1 - u) * inv).sum(), *(means @ ((1 - u) * inv)),
                        *(means.sum(axis=1) / row["d"])])
        names = ["time", "h", *[f"hx{i}" for i in range(k)], "th", *[f"thx{i}" for i in range(k)], *[f"m{i}" for i in range(k)]]
        yield pd.DataFrame(out, columns=names)


def leaf_values(hits, shares, values):
    """Shapley values, rows by leaves by path features, of leaves of one path length k.

    The weighted sum over coalitions is the integral over t from 0 to 1 of the
    other features' product of (1 - t) share + t hit. Its degree is k - 1, so
    Gauss-Legendre is exact on half as many points.
    """
    points, weights = np.polynomial.legendre.leggauss((shares.shape[1] + 1) // 2)
    total = np.zeros(hits.shape)
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = shares + t * (hits - shares)
        before, after = np.ones(hits.shape), np.ones(hits.shape)
        before[..., 1:] = np.cumprod(factor[..., :-1], axis=2)
        after[..., :-1] = np.cumprod(factor[..., :0:-1], axis=2)[..., ::-1]
        total += w * before * after
    return values[:, None] * (hits - shares) * total


def explain_block(x, groups):
    """Attributions, rows by features, from leaves grouped by path length."""
    phi = np.zeros(x.shape)
    for features, low, high, shares, values in groups:
        step = max(1, CELLS_PER_STEP // (len(x) * features.shape[1]))
        for at in range(0, len(features), step):
            cut = slice(at, at + step)
            seen = x[:, features[cut]]
            hits = ((seen > low[cut]) & (seen <= high[cut])).astype(float)
            part = leaf_values(hits, shares[cut], values[cut]).reshape(len(x), -1)
            flat = features[cut].reshape(-1)
            order = np.argsort(flat, kind="stable")
            used, starts = np.unique(flat[order], return_index=True)
            phi[:, used] += np.add.reduceat(part[:, order], starts, axis=1)
    return phi


def explain_rows(batches, groups, names, key):
    """One output row per input row and feature."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_PER_BLOCK):
            rows = batch.iloc[start:start + ROWS_PER_BLOCK]
            x = np.stack(rows["x"].to_numpy())
            yield pd.DataFrame(
                {
                    key: np.repeat(rows[key].to_numpy(), len(names)),
                    "feature": np.tile(names, len(rows)),
                    "value": x.reshape(-1),
                    "phi": explain_block(x, groups).reshape(-1),
                }
            )


def explain_totals(batches, groups, names):
    """One partial sum of absolute attributions per block and feature."""
    for batch in batches:
        for start in range(0, len(batch), ROWS_PER_BLOCK):
            x = np.stack(batch["x"].iloc[start:start + ROWS_PER_BLOCK].to_numpy())
            total = np.abs(explain_block(x, groups)).sum(axis=0)
            yield pd.DataFrame({"feature": names, "total": total, "n": len(x)})
