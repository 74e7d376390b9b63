"""The ensemble transform filter in NumPy, batched over grid points, and its grouped application."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIOR_SD = 0.04


def transform(y: np.ndarray, d: np.ndarray, rdiag: np.ndarray, inflation: float = 1.0, rtpp: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Perturbation weights, mean weights and analysis covariance for observations (p) of members (m).

    ``y`` is p x m with rows that sum to zero. Without observations the weights are those of the inflated prior.
    """
    m = y.shape[1]
    if not len(y):
        return np.sqrt(inflation) * np.eye(m), np.zeros(m), inflation / (m - 1) * np.eye(m)
    scaled = y / rdiag[:, None]
    values, vectors = np.linalg.eigh(scaled.T @ y + np.eye(m) * (m - 1) / inflation)
    pa_ = (vectors / values) @ vectors.T
    w = (vectors * np.sqrt((m - 1) / values)) @ vectors.T
    if rtpp:
        w = (1 - rtpp) * w + rtpp * np.sqrt(inflation) * np.eye(m)
    return w, pa_ @ (scaled.T @ d), pa_


def adapted_factor(p1: float, p2: float, p3: float, inflation: float) -> float:
    """Inflation after one adaptive update; ``p1`` is d'R^-1d, ``p2`` the mean square of members in the same norm, ``p3`` the sum of localization weights."""
    if not p3 or not p2:
        return inflation
    gain = (p1 - p3) / p2 - inflation
    spread = 2 / p3 * ((inflation * p2 + p3) / p2) ** 2
    return inflation + PRIOR_SD**2 / (spread + PRIOR_SD**2) * gain


def spread_factor(x: np.ndarray, cov: np.ndarray, inflation: float, rtps: float) -> float:
    """Factor of the perturbation weights that relaxes the spread of perturbations ``x`` to the prior's."""
    prior, after = x @ x, x @ cov @ x
    if prior <= 0 or after <= 0:
        return 1.0
    return rtps * np.sqrt(prior * inflation / (after * (len(x) - 1))) - rtps + 1


def analysed(x: np.ndarray, y: np.ndarray, d: np.ndarray, rdiag: np.ndarray, inflation: float, rtpp: float = 0.0, rtps: float = 0.0, beta: float = 1.0) -> np.ndarray:
    """Members of a variable after the update; with both relaxations set, that of perturbations is used. ``beta`` tapers the update."""
    w, mean, cov = transform(y, d, rdiag, inflation, rtpp)
    centre = x.mean()
    if rtps and not rtpp:
        w = w * spread_factor(x - centre, cov, inflation, rtps)
    return centre + (x - centre) @ (beta * (w + mean[:, None]) + (1 - beta) * np.eye(len(x)))


def one_sided(x: np.ndarray, y: np.ndarray, rdiag: np.ndarray) -> np.ndarray:
    """Perturbations after a one-sided transform; members are combinations that need not keep a zero sum."""
    values, vectors = np.linalg.eigh((y / rdiag[:, None]).T @ y / (x.shape[-1] - 1))
    return (x - x.mean()) @ (vectors / np.sqrt(np.maximum(values, 0) + 1))


def dimension(x: np.ndarray) -> float:
    """Effective number of directions of perturbations (points x members); 0 without spread."""
    values = np.maximum(np.linalg.eigvalsh(x.T @ x), 0)
    return float(np.sqrt(values).sum() ** 2 / values.sum()) if values.sum() > 0 else 0.0


def gain_inverse(x: np.ndarray, y: np.ndarray, rdiag: np.ndarray) -> np.ndarray:
    """Kalman gain of variables (n x m) for observations (p x m), by whichever inverse is the smaller: p x p or m x m."""
    m = x.shape[1]
    if len(y) <= m:
        return x @ y.T @ np.linalg.inv(y @ y.T + np.diag(rdiag) * (m - 1))
    scaled = y / rdiag[:, None]
    return x @ np.linalg.inv(np.eye(m) * (m - 1) + y.T @ scaled) @ scaled.T


SERIAL_AT_ONCE = 32


def serial(x: np.ndarray, y: np.ndarray, rdiag: np.ndarray) -> np.ndarray:
    """Perturbations of a variable after serial square-root updates with each observation in turn.

    An update is a matrix of members, I - f s's, so what all earlier ones do to an observation is one such matrix: ``turn``. Observations are
    taken some at a time; their updates go into it together, as I - S'WS with W = F(I + UF)^-1, U being the upper part of SS'. Work grows with the
    number of observations, not with its square.
    """
    m = len(x)
    turn = np.eye(m)
    for a in range(0, len(rdiag), SERIAL_AT_ONCE):
        own = y[a : a + SERIAL_AT_ONCE] @ turn
        factors = np.empty(len(own))
        for k, r in enumerate(rdiag[a : a + SERIAL_AT_ONCE]):
            seen = own[k]
            total = seen @ seen / (m - 1) + r
            factors[k] = 1 / ((m - 1) * total * (1 + np.sqrt(r / total)))
            later = own[k + 1 :]
            later -= np.outer(later @ (factors[k] * seen), seen)
        upper = np.triu(own @ own.T, 1)
        turn -= ((turn @ own.T) * factors) @ np.linalg.solve(np.eye(len(own)) + upper * factors, own)
    return (x - x.mean()) @ turn


def modes(x: np.ndarray, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (n x r), sizes (r) and combinations of members (r x m) of perturbations, the largest first: those with variance, or as few of them as explain ``share`` of it."""
    basis, size, right = np.linalg.svd(x, full_matrices=False)
    keep = size > size.max(initial=0) * 1e-8
    if share < 1 and keep.any():
        part = np.cumsum(size**2) / (size**2).sum()
        keep &= np.append(0.0, part[:-1]) < share
    return basis[:, keep], size[keep], right[keep]


def explained(x: np.ndarray, error: np.ndarray, share: float = 1.0) -> float:
    """Share of a vector's square (n) that lies in the space of perturbations (n x m), or of their leading modes; not a number without a vector."""
    inside = modes(x, share)[0].T @ error
    return float(inside @ inside / (error @ error)) if error @ error > 0 else float("nan")


def eigenspace_analysis(x: np.ndarray, y: np.ndarray, d: np.ndarray, rdiag: np.ndarray, delta: float = 0.0, share: float = 1.0) -> np.ndarray:
    """Members of a local state (n x m) updated in the eigenbasis of its covariance by observations (p x m)."""
    return eigenspace_of_sums(x, (y.T / rdiag) @ y, y.T @ (d / rdiag), delta, share)


def eigenspace_of_sums(x: np.ndarray, square: np.ndarray, pull: np.ndarray, delta: float = 0.0, share: float = 1.0) -> np.ndarray:
    """The same from sums over observations: ``square`` is Y'R^-1Y (m x m) and ``pull`` Y'R^-1d (m).

    ``delta`` adds that share of the mean analysis variance in each direction. Directions without variance are left out; with a ``share`` below 1,
    only as many leading modes are updated as explain it, and perturbations outside of them stay.
    """
    m = x.shape[1]
    centre = x.mean(axis=1, keepdims=True)
    basis, size, right = modes(x - centre, share)
    if not len(size):
        return x
    variance = size * size / (m - 1)
    own = right / size[:, None]
    after = variance[:, None] * np.linalg.inv(np.eye(len(size)) + own @ square @ own.T * variance)
    after = (after + after.T) / 2
    mean = basis @ (after @ (own @ pull))
    after = after + np.eye(len(size)) * (delta * np.trace(after) / len(size))
    inner = size[:, None] * right / variance[:, None]
    values, vectors = np.linalg.eigh(np.eye(m) + inner.T @ (after - np.diag(variance)) @ inner / (m - 1))
    inside = basis @ (size[:, None] * right)
    return centre + mean[:, None] + inside @ ((vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T) + (x - centre - inside)


def _per_point(packed: DataFrame, columns: tuple[str, ...], schema: str, of_row: Callable[..., list[tuple]]) -> DataFrame:
    """``of_row`` takes a row's columns and returns (mem, value) or (value,) tuples, which follow the point's gi and gj."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out = [(gi, gj, *new) for gi, gj, *values in zip(*(rows[c] for c in ("gi", "gj", *columns)), strict=True) for new in of_row(*values)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if isinstance(c[0], float) else pa.int32()) for c in zip(*out, strict=True)], names)

    names = [part.split()[0] for part in schema.split(", ")]
    return packed.select("gi", "gj", *columns).mapInArrow(work, schema)


def analysis(packed: DataFrame, inflation: float = 1.0, rtpp: float = 0.0, rtps: float = 0.0) -> DataFrame:
    """(gi, gj, mem, xa) from rows of a point: members ``x`` and its observations ``y`` (lists of arrays), ``d`` and ``rdiag``.

    A column ``beta``, if there is one, tapers the update of its point.
    """

    def of_row(x: list, y: list, d: list, r: list, beta: float = 1.0) -> list[tuple]:
        members = np.array(x)
        new = analysed(members, np.array(y).reshape(-1, len(x)), np.array(d), np.array(r), inflation, rtpp, rtps, beta)
        return list(enumerate(new.tolist(), 1))

    tapered = ("beta",) if "beta" in packed.columns else ()
    return _per_point(packed, ("x", "y", "d", "rdiag", *tapered), "gi int, gj int, mem int, xa double", of_row)


def deterministic(packed: DataFrame, inflation: float = 1.0) -> DataFrame:
    """(gi, gj, xa) of a run beside the ensemble: its own value ``x_det`` and departures ``d_det``, the ensemble's weights."""

    def of_row(x: list, y: list, d: list, r: list, x_det: float) -> list[tuple]:
        _, mean, _ = transform(np.array(y).reshape(-1, len(x)), np.array(d), np.array(r), inflation)
        members = np.array(x)
        return [(float(x_det + (members - members.mean()) @ mean),)]

    return _per_point(packed, ("x", "y", "d_det", "rdiag", "x_det"), "gi int, gj int, xa double", of_row)


def one_sided_spread(packed: DataFrame) -> DataFrame:
    """(gi, gj, sprd) after the one-sided transform: root of the sum of squares over members - 1."""

    def of_row(x: list, y: list, r: list) -> list[tuple]:
        new = one_sided(np.array(x), np.array(y).reshape(-1, len(x)), np.array(r))
        return [(float(np.sqrt(new @ new / (len(x) - 1))),)]

    return _per_point(packed, ("x", "y", "rdiag"), "gi int, gj int, sprd double", of_row)


def serial_update(packed: DataFrame) -> DataFrame:
    """(gi, gj, mem, xa_pert) after serial updates with the point's observations in the order of their ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gi, gj, *columns = batch.columns
            for k in range(len(batch)):
                x, y, r = (c[k].values for c in columns)  # arrays of one point, which may have very many observations
                x = x.to_numpy(zero_copy_only=False)
                new = serial(x, y.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(x)), r.to_numpy(zero_copy_only=False))
                place = [pa.array(np.full(len(x), c[k].as_py(), np.int32)) for c in (gi, gj)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(np.arange(1, len(x) + 1, dtype=np.int32)), pa.array(new)], ["gi", "gj", "mem", "xa_pert"])

    return packed.select("gi", "gj", "x", "y", "rdiag").mapInArrow(work, "gi int, gj int, mem int, xa_pert double")


def gains(packed: DataFrame, bias: float = 0.0) -> DataFrame:
    """(gi, gj, k, gain): the joint gain of a point for the k-th of its observations by id; points without any give no rows.

    With ``bias``, that of a bias ensemble whose perturbations are this share of the state's.
    """
    total = 1 + bias * bias

    def of_row(x: list, y: list, r: list) -> list[tuple]:
        if not y:
            return []
        members = np.array(x)
        share = bias * bias / np.sqrt(total) if bias else 1.0
        gain = gain_inverse(share * (members - members.mean())[None], np.sqrt(total) * np.array(y), np.array(r))[0]
        return list(enumerate(gain.tolist(), 1))

    return _per_point(packed, ("x", "y", "rdiag"), "gi int, gj int, k int, gain double", of_row)


def eigenspace(patches: DataFrame, delta: float = 0.0, share: float = 1.0) -> DataFrame:
    """(gi, gj, point, mem, xa) of patches: ``x`` lists the members of each point, ``sums`` is that of its observations or null."""

    def of_row(x: list, sums: bytes | None) -> list[tuple]:
        state = np.array(x)
        m = state.shape[1]
        both = np.frombuffer(sums).reshape(m + 1, m) if sums else np.zeros((m + 1, m))
        new = eigenspace_of_sums(state, both[:m], both[m], delta, share)
        return [(point, mem, float(v)) for point, row in enumerate(new, 1) for mem, v in enumerate(row, 1)]

    return _per_point(patches, ("x", "sums"), "gi int, gj int, point int, mem int, xa double", of_row)


SUMS_AT_ONCE = 64


def ensemble_sums(obs: DataFrame) -> DataFrame:
    """(gi, gj, sums): Y'R^-1Y and Y'R^-1d of all observations (gi, gj, y, dep, rdiag) of each patch, m + 1 rows of m numbers.

    Summed within batches first, then over batches in the order of patches, so that few sums are held at a time.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gi, gj, dep, rdiag = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            y = batch.column(2)
            order = np.lexsort((gj, gi))
            cuts = np.flatnonzero((np.diff(gi[order], prepend=-1) != 0) | (np.diff(gj[order], prepend=-1) != 0))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                of_members = np.array(y.take(pa.array(mine)).to_pylist())
                scaled = of_members / rdiag[mine, None]
                rows.append((int(gi[mine[0]]), int(gj[mine[0]]), np.vstack([scaled.T @ of_members, dep[mine] @ scaled]).tobytes()))
                if len(rows) == SUMS_AT_ONCE:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0)
        for batch in batches:
            for gi, gj, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == (gi, gj):
                    total = total + np.frombuffer(sums)
                    continue
                if at:
                    yield made([(*at, total.tobytes())])
                at, total = (gi, gj), np.frombuffer(sums)
        if at:
            yield made([(*at, total.tobytes())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["gi", "gj", "sums"])

    schema = "gi int, gj int, sums binary"
    parts = obs.select("gi", "gj", "y", "dep", "rdiag").mapInArrow(first, schema)
    return parts.repartition("gi", "gj").sortWithinPartitions("gi", "gj").mapInArrow(then, schema)


def at_observations(hx: DataFrame, local: DataFrame, dep: DataFrame, inflation: float = 1.0) -> DataFrame:
    """(obs_id, mem, xa): the analysis in observation space; ``local`` (target, obs_id, rdiag) pairs each target with what it feels."""
    grid = hx.select(F.col("obs_id").alias("gi"), F.lit(0).alias("gj"), "mem", F.col("hx").alias("x"))
    felt = local.select(F.col("target").alias("gi"), F.lit(0).alias("gj"), "obs_id", "rdiag")
    out = analysis(packed_points(grid, felt, hx, dep), inflation)
    return out.select(F.col("gi").cast("long").alias("obs_id"), "mem", "xa")


def ensemble_dimension(patches: DataFrame) -> DataFrame:
    """(gi, gj, edim) of patches whose column ``x`` lists the members of each of their points."""

    def of_row(x: list) -> list[tuple]:
        values = np.array(x)
        return [(dimension(values - values.mean(axis=1, keepdims=True)),)]

    return _per_point(patches, ("x",), "gi int, gj int, edim double", of_row)


def explained_variance(patches: DataFrame, share: float = 1.0) -> DataFrame:
    """(gi, gj, expvar, edim) of patches: members ``x`` of each of their points, and ``error``, the mean's error at them. The first is how much of the error lies in the members' space, the other its dimension."""

    def of_row(x: list, error: list) -> list[tuple]:
        values = np.array(x)
        values = values - values.mean(axis=1, keepdims=True)
        return [(explained(values, np.array(error), share), dimension(values))]

    return _per_point(patches, ("x", "error"), "gi int, gj int, expvar double, edim double", of_row)


def packed_points(grid: DataFrame, local: DataFrame, hx: DataFrame, dep: DataFrame | None) -> DataFrame:
    """One row per point: its members in order, and perturbations, departures and error variances of its local observations.

    Without ``dep``, the departures are a column of ``local``, which saves a join.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("mem", c))), lambda s: s[c])
    centred = F.transform("h", lambda v: v - F.aggregate("h", F.lit(0.0), lambda a, b: a + b) / F.size("h"))
    perturbed = hx.groupBy("obs_id").agg(ordered("hx").alias("h")).select("obs_id", centred.alias("y"))
    seen = local.filter("obs_id is not null")
    seen = seen.select("gi", "gj", "obs_id", "rdiag", "dep") if dep is None else seen.select("gi", "gj", "obs_id", "rdiag").join(dep.select("obs_id", "dep"), "obs_id")
    return packed_seen(grid, seen.join(perturbed, "obs_id"))


def packed_seen(grid: DataFrame, seen: DataFrame) -> DataFrame:
    """``packed_points`` from pairs (gi, gj, obs_id, dep, rdiag) that have the observation's centred members ``y``."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("mem", c))), lambda s: s[c])
    members = grid.groupBy("gi", "gj").agg(ordered("x").alias("x"))
    item = F.array_sort(F.collect_list(F.struct("obs_id", "y", "dep", "rdiag")))
    obs = seen.groupBy("gi", "gj").agg(item.alias("o"))
    joined = members.join(obs, ["gi", "gj"], "left")
    none = F.array().cast("array<double>")
    return joined.select("gi", "gj", "x", F.coalesce(F.col("o.y"), F.array().cast("array<array<double>>")).alias("y"), F.coalesce(F.col("o.dep"), none).alias("d"), F.coalesce(F.col("o.rdiag"), none).alias("rdiag"))
