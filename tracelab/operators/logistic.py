"""Many logistic models at once: all runs, folds, penalties and rounds in one job per Newton step.

A model is a set of rows (of one run, without some folds or in one random half), a scaling and a penalty. A step is one pass
over the rows: every task adds up loss, gradient and Hessian of each model over its rows, and the sums (some kilobytes a
model) are solved together on the driver. An L1 penalty takes a proximal step: coordinate descent on the quadratic
model, so zeros are exact. A step that does not lower the objective is halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.functions.matrix_sums import matrix, summed

STEPS, TOLERANCE, SWEEPS = 40, 1e-6, 200
#: Models whose sums are on the driver at a time (37 features: 6 KB each).
WAVE = 2000
HASH = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Spec:
    """Rows and penalty of a model.

    ``without``: pairs of a place in ``folds`` and a fold to leave out; ``half``: the round whose random half of the
    rows is taken. ``strength`` multiplies the penalty, over summed loss; ``center`` and ``spread`` scale the features.
    """

    run: str
    strength: float
    l1: bool
    center: tuple[float, ...]
    spread: tuple[float, ...]
    without: tuple[tuple[int, int], ...] = ()
    half: int | None = None


def in_half(hashes: np.ndarray, number: int) -> np.ndarray:
    """A random half of the rows for each round number, from one 64-bit hash a row."""
    mixed = (hashes.astype(np.uint64) ^ (np.uint64(number + 1) * HASH)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (mixed >> np.uint64(63)) == 1


def members(spec: Spec, folds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.ones(len(hashes), dtype=bool) if spec.half is None else in_half(hashes, spec.half)
    for place, fold in spec.without:
        mask &= folds[:, place] != fold
    return mask


def design(x: np.ndarray, spec: Spec) -> np.ndarray:
    """Scaled features with a column of ones in front."""
    return np.column_stack([np.ones(len(x)), (x - np.array(spec.center)) / np.array(spec.spread)])


def _grouped(specs: Sequence[Spec]) -> dict[str, dict[tuple, list[int]]]:
    """Models by run and by the matrix that they share."""
    out: dict[str, dict[tuple, list[int]]] = {}
    for i, s in enumerate(specs):
        out.setdefault(s.run, {}).setdefault((s.without, s.half, s.center, s.spread), []).append(i)
    return out


def by_run(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Row numbers of each run in a batch."""
    runs = batch.column("run_id").dictionary_encode()
    codes = runs.indices.to_numpy()
    for code, run in enumerate(runs.dictionary.to_pylist()):
        yield run, np.flatnonzero(codes == code)


def _sums(specs: Sequence[Spec], active: np.ndarray, weights: np.ndarray, width: int, places: int):
    """What a task adds for (model): loss, rows, gradient and upper Hessian."""
    upper = np.triu_indices(width + 1)
    groups = _grouped([specs[i] for i in active])

    def partial(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x, label = matrix(batch.column("x"), width), batch.column("label").to_numpy().astype(np.float64)
        folds = matrix(batch.column("folds"), places) if places else np.zeros((len(label), 0))
        hashes = batch.column("hash").to_numpy()
        for run, rows in by_run(batch):
            for own in groups.get(run, {}).values():
                first = specs[active[own[0]]]
                mine = rows[members(first, folds[rows], hashes[rows])]
                if not len(mine):
                    continue
                z, y = design(x[mine], first), label[mine]
                for at in own:
                    t = z @ weights[active[at]]
                    p = 1 / (1 + np.exp(-np.clip(t, -500, 500)))
                    loss = (np.logaddexp(0, t) - y * t).sum()
                    hessian = (z * (p * (1 - p))[:, None]).T @ z
                    yield (int(active[at]),), np.concatenate([[loss, len(y)], z.T @ (p - y), hessian[upper]])

    return partial


def _newton(gradient: np.ndarray, hessian: np.ndarray, weights: np.ndarray, strength: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Directions of all models."""
    models, width = weights.shape
    out = np.zeros_like(weights)
    free = np.ones(width)
    free[0] = 0.0  # the intercept is not penalised
    if (~l1).any():
        some = np.flatnonzero(~l1)
        ridge = strength[some, None] * free
        full = hessian[some] + np.einsum("mi,ij->mij", ridge + 1e-10, np.eye(width))
        out[some] = np.linalg.solve(full, -(gradient[some] + ridge * weights[some])[..., None])[..., 0]
    if l1.any():
        some = np.flatnonzero(l1)
        h, g, w, lam = hessian[some], gradient[some], weights[some], strength[some, None] * free
        step, slope = np.zeros_like(w), g.copy()  # slope: gradient of the quadratic at the step
        curve = np.einsum("mii->mi", h)
        for _ in range(SWEEPS):
            moved = 0.0
            for j in range(width):
                c = np.maximum(curve[:, j], 1e-12)
                target = w[:, j] + step[:, j] - slope[:, j] / c
                new = np.sign(target) * np.maximum(np.abs(target) - lam[:, j] / c, 0.0)
                change = np.where(curve[:, j] > 1e-9, new - w[:, j] - step[:, j], 0.0)
                step[:, j] += change
                slope += change[:, None] * h[:, j]
                moved = max(moved, float(np.abs(change).max(initial=0.0)))
            if moved < TOLERANCE / 10:
                break
        out[some] = step
    return out


def fit_all(rows: DataFrame, specs: Sequence[Spec], width: int, places: int = 0) -> np.ndarray:
    """Weights of all models, intercept first, of scaled features; NaN for a model whose rows have one class or none.

    ``rows`` are (run_id, label, x array, folds array, hash), read once per Newton step: keep them in a table.
    """
    out = [_fit_wave(rows, specs[i : i + WAVE], width, places) for i in range(0, len(specs), WAVE)]
    return np.concatenate(out) if out else np.zeros((0, width + 1))


def _fit_wave(rows: DataFrame, specs: Sequence[Spec], width: int, places: int) -> np.ndarray:
    models, size = len(specs), width + 1
    strength, l1 = np.array([s.strength for s in specs]), np.array([s.l1 for s in specs])
    best, trial = np.zeros((models, size)), np.zeros((models, size))
    lowest, step = np.full(models, np.inf), np.zeros((models, size))
    active, fitted = np.arange(models), np.zeros(models, dtype=bool)
    upper = np.triu_indices(size)

    def objective(loss: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = weights[:, 1:]
        return loss + strength[at] * np.where(l1[at], np.abs(own).sum(axis=1), 0.5 * (own**2).sum(axis=1))

    for _ in range(STEPS):
        table = summed(rows, {"model": "int"}, _sums(specs, active, trial, width, places)).toArrow()
        if not table.num_rows:
            break
        at = table.column("model").to_numpy()
        totals = matrix(table.column("total").combine_chunks(), 2 + size + len(upper[0]))
        gradient = totals[:, 2 : 2 + size]
        if not fitted.any():  # at zero, the gradient of the intercept is n / 2 - positives
            n = totals[:, 1]
            positives = n / 2 - gradient[:, 0]
            both = (positives > 0.5) & (positives < n - 0.5)
            fitted[at[both]] = True
            at, totals, gradient = at[both], totals[both], gradient[both]
            if not len(at):
                break
        value = objective(totals[:, 0], trial[at], at)
        better = value <= lowest[at] + 1e-10 * np.abs(lowest[at])
        good, bad = at[better], at[~better]
        lowest[good], best[good] = value[better], trial[good]
        hessian = np.zeros((int(better.sum()), size, size))
        hessian[:, upper[0], upper[1]] = totals[better, 2 + size :]
        hessian[:, upper[1], upper[0]] = totals[better, 2 + size :]
        step[good] = _newton(gradient[better], hessian, best[good], strength[good], l1[good])
        step[bad] /= 2
        trial[at] = best[at] + step[at]
        active = at[np.abs(step[at]).max(axis=1) > TOLERANCE]
        if not len(active):
            break
    best[~fitted] = np.nan
    return best


def with_arrays(features: DataFrame, names: Sequence[str], folds: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(run_id, sample_id, label, x, folds, hash, ...) rows for ``fit_all``; feature columns become the array ``x``."""
    rest = [c for c in features.columns if c not in {*names, *folds, "label"}]
    return features.select(
        *rest, F.col("label").cast("int").alias("label"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"),
        F.array(*[F.col(f).cast("double") for f in folds]).cast("array<double>").alias("folds"), F.xxhash64("run_id", "sample_id", F.lit(seed)).alias("hash"))


#: Rows of a model: (run, (place in folds, fold left out), ...), or every row of a run.
Mask = tuple[str, tuple[tuple[int, int], ...]]


def scalings(rows: DataFrame, masks: Sequence[Mask], width: int, places: int = 0) -> dict[Mask, tuple[int, tuple, tuple]]:
    """(rows, means, sample deviations) of ``x`` for each mask; a constant feature has the deviation 1.

    Sums are taken around the mean of the run, so that nothing is lost to large offsets.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    found = rows.groupBy("run_id").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("mean")).collect()
    middle = {r["run_id"]: np.array(r["mean"]) for r in found}
    own: dict[str, list[int]] = {}
    for i, (run, _) in enumerate(masks):
        own.setdefault(run, []).append(i)

    def partial(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        x = matrix(batch.column("x"), width)
        folds = matrix(batch.column("folds"), places) if places else np.zeros((len(x), 0))
        for run, at in by_run(batch):
            for i in own.get(run, ()):
                mine = at[members(Spec(run, 0.0, False, (), (), masks[i][1]), folds[at], np.zeros(len(at)))]
                d = x[mine] - middle[run]
                yield (i,), np.concatenate([[len(mine)], d.sum(axis=0), (d**2).sum(axis=0)])

    out: dict[Mask, tuple[int, tuple, tuple]] = {}
    for r in summed(rows, {"mask": "int"}, partial).collect():
        total, center = np.array(r["total"]), middle[masks[r["mask"]][0]]
        n, shift = total[0], total[1 : 1 + width] / max(total[0], 1)
        spread = np.sqrt(np.maximum(total[1 + width :] - n * shift**2, 0) / max(n - 1, 1))
        constant = spread <= 1e-9 * np.maximum(1e-3, np.abs(center))
        out[masks[r["mask"]]] = int(n), tuple((center + shift).tolist()), tuple(np.where(constant, 1.0, spread).tolist())
    return out


def raw_weights(weights: np.ndarray, spec: Spec) -> tuple[float, list[float]]:
    """(intercept, weights) for features as they are."""
    own = weights[1:] / np.array(spec.spread)
    return float(weights[0] - (own * np.array(spec.center)).sum()), own.tolist()


def held_out(rows: DataFrame, specs: Sequence[Spec], settings: Sequence[int], weights: np.ndarray, width: int) -> DataFrame:
    """(run_id, fold, setting, label, score) of every row by the models that left out its fold (place 0 of ``folds``)."""
    groups = _grouped(specs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, label, folds = matrix(batch.column("x"), width), batch.column("label").to_numpy(), matrix(batch.column("folds"), 1)[:, 0]
            for run, at in by_run(batch):
                for (without, *_), own in groups.get(run, {}).items():
                    mine = at[folds[at] == without[0][1]] if without else at[:0]
                    if not len(mine):
                        continue
                    z = design(x[mine], specs[own[0]])
                    for i in own:
                        if not np.isnan(weights[i][0]):
                            yield pa.record_batch({
                                "run_id": pa.array([run] * len(mine)), "fold": pa.array(folds[mine].astype(np.int32)),
                                "setting": pa.array(np.full(len(mine), settings[i], dtype=np.int32)), "label": pa.array(label[mine].astype(np.int32)),
                                "score": pa.array(z @ weights[i])})

    return rows.mapInArrow(work, "run_id string, fold int, setting int, label int, score double")
