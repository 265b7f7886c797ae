"""Small traces as NumPy arrays, stored rows and cells, and the features restated in NumPy."""

import numpy as np

from tracelab.sources import trace

CHANNELS = ["entropy", "prob", "x0_id", "masked"]


def rows_of(spark, samples, post_commit=False, run_id="r"):
    """samples: dicts of [T][D] lists for the four channels."""
    records = [
        (run_id, i, 0, len(s["entropy"][0]), post_commit, *[[list(map(kind, row)) for row in np.asarray(s[c]).tolist()]
         for c, kind in (("entropy", float), ("prob", float), ("x0_id", int), ("masked", bool))])
        for i, s in enumerate(samples)
    ]
    schema = (
        "run_id STRING, sample_id BIGINT, start_idx INT, max_new_tokens INT, post_commit BOOLEAN, entropy ARRAY<ARRAY<DOUBLE>>, "
        "prob ARRAY<ARRAY<DOUBLE>>, x0_id ARRAY<ARRAY<INT>>, masked ARRAY<ARRAY<BOOLEAN>>"
    )
    return spark.createDataFrame(records, schema)


def cells_of(spark, samples, pad_id=0, **options):
    return trace.explode_trace(rows_of(spark, samples, **options), pad_id=pad_id, with_lag=True)


def random_samples(n, steps, width, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        reveal = rng.integers(1, steps + 2, width)
        masked = np.arange(steps)[:, None] < reveal[None, :]
        masked[:, rng.integers(0, width)] = False
        again = (rng.random((steps, width)) < 0.05) & (np.arange(steps)[:, None] > 1)
        out.append({
            "entropy": rng.gamma(1.0, 0.7, (steps, width)), "prob": rng.uniform(0.01, 1.0, (steps, width)),
            "x0_id": rng.integers(0, 2, (steps, width)), "masked": masked | again,
        })
    return out


def spread_by(x, m, axis):
    """Mean over lines of the population variance of the masked values, lines with fewer than two left out."""
    lines = [v[k] for v, k in zip(np.moveaxis(x, axis, -1), np.moveaxis(m, axis, -1))]
    found = [np.var(v) for v in lines if v.size > 1]
    return float(np.mean(found)) if found else 0.0


def slope(y, t):
    t = np.asarray(t, float)
    a = np.sum((t - t.mean()) * (y - np.mean(y))) / np.sum((t - t.mean()) ** 2)
    return a, np.mean(y) - a * t.mean()


def expected(s, pad_id=0):
    e, p, x0 = (np.asarray(s[c], float) for c in ("entropy", "prob", "x0_id"))
    m = np.asarray(s["masked"], bool)
    steps = len(e)
    ju = np.zeros_like(m)
    ju[1:] = m[:-1] & ~m[1:]
    ju[-1] |= m[-1]
    padding = np.array([m[:, d].any() and (x0[m[:, d], d] == pad_id).all() for d in range(m.shape[1])])
    eff = m & ~padding
    every = np.ones_like(m)
    out = {}
    for x, name in ((e, "Entropy"), (p, "LogProb")):
        masked_name = "MeanMaskedEntropy" if name == "Entropy" else "MeanLogProbMasked"
        out[f"Mean{name}"] = x.mean()
        out[masked_name] = x[m].sum() / max(m.sum(), 1)
        out[masked_name + "NoPad"] = x[eff].sum() / max(eff.sum(), 1)
        out[f"Mean{name}JustUnmasked"] = x[ju].mean() if ju.any() else 0.0
        out[f"Var{name}"] = spread_by(x, every, 0)
        out[f"Var{name}AcrossTokens"] = spread_by(x, every, 1)
        masked_var = "VarMaskedEntropy" if name == "Entropy" else "VarLogProbMasked"
        out[masked_var] = spread_by(x, m, 0)
        out[masked_var + "AcrossTokens"] = spread_by(x, m, 1)
        out[masked_var + "AcrossTokensNoPad"] = spread_by(x, eff, 1)
        out[f"Var{name}JustUnmasked"] = np.var(x[ju][1:]) if ju.sum() > 1 else None
        a, b = slope(np.log(x + 1e-10).mean(axis=1), range(steps))
        out[f"Alpha{name}"], out[f"Beta{name}"] = a, b
    level = e.mean(axis=1)
    starts = [t for t in range(0, steps, 5) if t < steps - 5]
    tau = [(level[t + 5] - level[t]) / 5 for t in starts]
    out["MeanVarTauEntropy"] = np.mean(tau) if tau else None
    out["VarTauEntropy"] = np.var(tau) if tau else None
    curve = np.array([np.var(r[k]) for r, k in zip(e, m) if k.sum() > 1])
    out["AUCVarMaskedEntropyCurve"] = float(((curve[1:] + curve[:-1]) / 2).sum()) if curve.size else 0.0
    out["MaxVarMaskedEntropyCurve"] = curve.max() if curve.size else None
    out["ArgmaxVarMaskedEntropyCurve"] = int(np.argmax(curve)) if curve.size else None
    if curve.size > 1 and np.var(curve) > 0:
        z = curve - curve.mean()
        out["SkewnessVarMaskedEntropyCurve"] = (z**3).mean() / (z**2).mean() ** 1.5
        out["KurtosisVarMaskedEntropyCurve"] = (z**4).mean() / (z**2).mean() ** 2 - 3
    if curve.size > 1:
        d = np.gradient(curve)
        out["MeanCurvatureMaskedEntropyCurve"] = (np.abs(np.gradient(d)) / (1 + d**2) ** 1.5).mean()
    a, b = slope(np.log(level + 1e-10), range(steps))
    out["AlphaEntropyAvg"], out["BetaEntropyAvg"] = a, b
    return out
