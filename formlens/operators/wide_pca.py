"""Principal components of many masks of many features, where neither matrix of products fits anywhere.

The centred features are cut into tiles, a block of masks by a slice of features. A basis of a few columns is kept by
slice. Multiplying it by the covariance takes two passes over the tiles, which stay where they are: only pieces of the
basis and of its products travel. The leading components are found by locally optimal block conjugate gradients; the
driver sees sums of products of the basis's columns, and nothing as long as a mask or a feature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import cut

#: Masks and features of a tile, about; a tile has 4 MB.
ROWS, WIDTH = 512, 1024
#: Arrays that one group adds up; more are added in two steps.
FAN = 64


@dataclass(frozen=True)
class WidePca:
    """slices: slice, mean (array), vectors (k arrays): each component's and the mean's part in a slice of WIDTH features."""

    slices: DataFrame
    variance: np.ndarray
    ratio: np.ndarray
    residual: np.ndarray  # length of C v - variance v, over the first variance
    width: int

    def table(self) -> DataFrame:
        """k, variance, variance_ratio, component (whole, so a row is as long as one mask's features)."""
        parts = self.slices.select("slice", F.posexplode("vectors").alias("k", "v"))
        whole = parts.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("slice", "v"))).alias("p"))
        known = [F.element_at(F.array(*[F.lit(float(x)) for x in a]), F.col("k") + 1) for a in (self.variance, self.ratio)]
        return whole.select("k", known[0].alias("variance"), known[1].alias("variance_ratio"), F.flatten(F.col("p")["v"]).alias("component"))

    def mean(self) -> DataFrame:
        """i, mean: one row a feature."""
        return self.slices.select("slice", F.posexplode("mean").alias("at", "mean")).select((F.col("slice") * self.width + F.col("at")).alias("i"), "mean")


def _read(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, columns) if columns else np.zeros((0, 0))


def _none(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _added(parts: DataFrame, key: str, other: str, others: int) -> DataFrame:
    """key, v: the sums of the binary arrays v, in the order of `other`, whose numbers are below `others`."""

    def add(by: list[str], order: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(got: pd.DataFrame) -> pd.DataFrame:
            got = got.sort_values(order)
            total = np.zeros(len(got["v"].iloc[0]) // 8)
            for v in got["v"]:
                total += np.frombuffer(v, np.float64)
            return pd.DataFrame({**{c: got[c].iloc[:1] for c in by}, "v": [total.tobytes()]})

        return one

    if others > FAN:
        step = max(FAN, int(np.ceil(np.sqrt(others))))
        parts = parts.withColumn("part", F.floor(F.col(other) / step))
        parts = parts.groupBy(key, "part").applyInPandas(add([key, "part"], other), f"{key} long, part long, v binary")
        other = "part"
    return parts.groupBy(key).applyInPandas(add([key], other), f"{key} long, v binary")


def _pieces(features: DataFrame, blocks: int, width: int) -> DataFrame:
    """slice, block, mask_id, v: every mask's features, cut up."""
    rows = features.select(F.col("mask_id").cast("long").alias("mask_id"), F.pmod(F.xxhash64("mask_id"), F.lit(blocks)).alias("block"), F.col("features").cast("array<double>").alias("f"))
    last = F.floor((F.size("f") - 1) / width)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice"))
    return rows.select("slice", "block", "mask_id", F.slice("f", (F.col("slice") * width + 1).cast("int"), width).alias("v"))


def _each(column: str, n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(column)


class _Tiles:
    """Centred tiles, and products with them."""

    def __init__(self, features: DataFrame, n: int, features_of_each: int, rows: int, width: int, means: DataFrame | None = None) -> None:
        self.blocks, self.slices = max(1, -(-n // rows)), -(-features_of_each // width)
        pieces = _pieces(features, self.blocks, width)

        def total(got: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(got.sort_values("mask_id")["v"])
            return pd.DataFrame({"slice": got["slice"].iloc[:1], "block": got["block"].iloc[:1], "v": [x.sum(0).tobytes()]})

        if means is None:
            means = _added(pieces.groupBy("slice", "block").applyInPandas(total, "slice long, block long, v binary"), "slice", "block", self.blocks)
            means = cut(means)
        self.means = means  # slice, v: sums over the n masks, or n times the means of others

        def centred(got: pd.DataFrame, mean: pd.DataFrame) -> pd.DataFrame:
            if not len(got):
                return _none("slice", "block", "ids", "v", "width", "square")
            got = got.sort_values("mask_id")
            x = np.stack(got["v"]) - np.frombuffer(mean["v"].iloc[0], np.float64) / n
            return pd.DataFrame({"slice": got["slice"].iloc[:1], "block": got["block"].iloc[:1], "ids": [got["mask_id"].tolist()], "v": [x.tobytes()], "width": [x.shape[1]], "square": [float((x * x).sum())]})

        spread = means.select("slice", "v", _each("block", self.blocks))
        self.tiles = pieces.groupBy("slice", "block").cogroup(spread.groupBy("slice", "block")).applyInPandas(
            centred, "slice long, block long, ids array<long>, v binary, width int, square double").persist(StorageLevel.MEMORY_AND_DISK)

    def times(self, basis: DataFrame, columns: int) -> DataFrame:
        """block, v: the centred features times the basis (slice, v)."""

        def part(tile: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            if not len(tile) or not len(m):
                return _none("slice", "block", "v")
            x = _read(tile["v"].iloc[0], int(tile["width"].iloc[0])) @ _read(m["v"].iloc[0], columns)
            return pd.DataFrame({"slice": tile["slice"], "block": tile["block"], "v": [x.tobytes()]})

        spread = basis.select("slice", "v", _each("block", self.blocks))
        parts = self.tiles.groupBy("slice", "block").cogroup(spread.groupBy("slice", "block")).applyInPandas(part, "slice long, block long, v binary")
        return _added(parts, "block", "slice", self.slices)

    def back(self, product: DataFrame, columns: int, by: float) -> DataFrame:
        """slice, v: the transposed features times product (block, v), over `by`."""

        def part(tile: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            if not len(tile):
                return _none("slice", "block", "v")
            x = _read(tile["v"].iloc[0], int(tile["width"].iloc[0])).T @ _read(m["v"].iloc[0], columns) / by
            return pd.DataFrame({"slice": tile["slice"], "block": tile["block"], "v": [x.tobytes()]})

        spread = product.select("block", "v", _each("slice", self.slices))
        parts = self.tiles.groupBy("slice", "block").cogroup(spread.groupBy("slice", "block")).applyInPandas(part, "slice long, block long, v binary")
        return _added(parts, "slice", "block", self.blocks)

    def covariance_times(self, basis: DataFrame, columns: int, n: int) -> DataFrame:
        return self.back(self.times(basis, columns), columns, max(1, n - 1))


def _by_slice(left: DataFrame, right: DataFrame, body: Callable[[int, bytes, bytes], dict], schema: str) -> DataFrame:
    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [key[0]], **{k: [v] for k, v in body(key[0], a["v"].iloc[0], b["v"].iloc[0]).items()}})

    return left.groupBy("slice").cogroup(right.groupBy("slice")).applyInPandas(one, f"slice long, {schema}")


def _products(s: np.ndarray, cs: np.ndarray) -> bytes:
    return np.concatenate([(s.T @ s).ravel(), (s.T @ cs).ravel()]).tobytes()


def _ritz(g: np.ndarray, a: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The b largest Ritz values of a basis with products g and covariance a, and their combinations of its columns."""
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    values, vectors = np.linalg.eigh(g * np.outer(scale, scale))
    use = values > 1e-12 * values[-1]  # columns that others make up add nothing
    whiten = scale[:, None] * vectors[:, use] / np.sqrt(values[use])
    inner = whiten.T @ ((a + a.T) / 2) @ whiten
    theta, z = np.linalg.eigh(inner)
    return theta[::-1][:b], (whiten @ z[:, ::-1])[:, :b]


def _moved(y: np.ndarray, theta: np.ndarray, columns: int, b: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The new basis, its products, its residuals and, but for the first time, the direction that it came by and that one's products."""

    def one(got: pd.DataFrame) -> pd.DataFrame:
        both = _read(got["v"].iloc[0], 2 * columns)
        s, cs = both[:, :columns], both[:, columns:]
        v, cv = s @ y, cs @ y
        out = [v, cv, cv - v * theta]
        if columns > b:
            out += [s[:, b:] @ y[b:], cs[:, b:] @ y[b:]]
        return pd.DataFrame({"slice": got["slice"], "v": [np.hstack(out).tobytes()]})

    return one


def _columns(of: int, first: int, n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": got["slice"], "v": [np.ascontiguousarray(_read(got["v"].iloc[0], of)[:, first : first + n]).tobytes()]})

    return one


def _joined(more: bool, b: int) -> Callable[[int, bytes, bytes], dict]:
    def one(_: int, v: bytes, cr: bytes) -> dict:
        n = 5 if more else 3
        part = np.split(_read(v, n * b), n, axis=1)
        s, cs = np.hstack([part[0], part[2], *part[3:4]]), np.hstack([part[1], _read(cr, b), *part[4:5]])
        return {"v": np.hstack([s, cs]).tobytes(), "g": _products(s, cs)}

    return one


def fit(features: DataFrame, k: int, tolerance: float = 1e-7, most_steps: int = 200, seed: int = 0, rows: int = ROWS, width: int = WIDTH) -> WidePca:
    """The k leading principal components of features (mask_id, features), until each residual is under tolerance times the first variance.

    A mask_id stands for one row; null features take no part and others must be of one length. Fewer components come
    back where there are fewer features, or fewer masks less one. If most_steps don't reach the tolerance, the residuals
    say so. Without rows, or with features of different lengths, it raises ValueError.
    """
    features = features.filter("features is not null").select("mask_id", "features")
    told = features.agg(F.count("*").alias("n"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).first()
    if not told.n or told.least != told.most or not told.most:
        raise ValueError("features must be there and of one length")
    n = told.n
    k = min(k, told.most, max(1, n - 1))
    b = min(k + max(4, k // 4), told.most)
    tiles = _Tiles(features, n, told.most, rows, width)
    total = tiles.tiles.agg(F.sum("square")).first()[0] / max(1, n - 1)

    def start(got: pd.DataFrame) -> pd.DataFrame:
        s = len(got["v"].iloc[0]) // 8
        return pd.DataFrame({"slice": got["slice"], "v": [np.random.default_rng((seed, int(got["slice"].iloc[0]))).normal(size=(s, b)).tobytes()]})

    # A slice's state: its rows of the basis and, beside them, of the covariance times the basis.
    first = cut(tiles.means.groupBy("slice").applyInPandas(start, "slice long, v binary"))

    def opened(_: int, v: bytes, cv: bytes) -> dict:
        s, cs = _read(v, b), _read(cv, b)
        return {"v": np.hstack([s, cs]).tobytes(), "g": _products(s, cs)}

    state = cut(_by_slice(first, tiles.covariance_times(first, b, n), opened, "v binary, g binary"))
    columns = b

    def sums(state: DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(_added(state.select(F.lit(0).cast("long").alias("all"), "slice", F.col("g").alias("v")), "all", "slice", tiles.slices).first().v, np.float64)
        return tuple(flat.reshape(2, columns, columns))

    for _ in range(most_steps):
        g, a = sums(state, columns)
        if columns > b and np.sqrt(np.diag(g)[b : b + k]).max() <= tolerance * max(theta[0], 1e-300):  # noqa: F821 (set by the step before)
            break
        theta, y = _ritz(g, a, b)

        more = columns > b
        now = state.groupBy("slice").applyInPandas(_moved(y, theta, columns, b), "slice long, v binary")
        residuals = now.groupBy("slice").applyInPandas(_columns((5 if more else 3) * b, 2 * b, b), "slice long, v binary")
        state = cut(_by_slice(now, tiles.covariance_times(residuals, b, n), _joined(more, b), "v binary, g binary"))
        columns = 3 * b if more else 2 * b

    # The products of the basis with the covariance were carried along; the last ones are made anew.
    basis = state.groupBy("slice").applyInPandas(_columns(2 * columns, 0, b), "slice long, v binary")
    state = cut(_by_slice(basis, tiles.covariance_times(basis, b, n), opened, "v binary, g binary"))
    theta, y = _ritz(*sums(state, b), b)
    theta, y = np.maximum(theta[:k], 0.0), y[:, :k]

    def last(got: pd.DataFrame) -> pd.DataFrame:
        both = _read(got["v"].iloc[0], 2 * b)
        v, r = both[:, :b] @ y, both[:, b:] @ y - both[:, :b] @ y * theta
        at = np.abs(v).argmax(0)
        peak = v[at, np.arange(v.shape[1])]
        return pd.DataFrame({"slice": got["slice"], "v": [v.tobytes()], "square": [(r * r).sum(0)], "peak": [peak]})

    done = cut(state.groupBy("slice").applyInPandas(last, "slice long, v binary, square array<double>, peak array<double>"))
    told = done.select("slice", F.posexplode(F.arrays_zip("square", "peak")).alias("k", "p")).groupBy("k").agg(
        F.sum("p.square").alias("square"), F.max_by("p.peak", F.struct(F.abs("p.peak"), -F.col("slice"))).alias("peak")).toPandas().sort_values("k")  # k rows
    sign = np.where(told["peak"].to_numpy() < 0, -1.0, 1.0)

    def named(_: int, v: bytes, mean: bytes) -> dict:
        return {"mean": np.frombuffer(mean, np.float64) / n, "vectors": list((_read(v, k) * sign).T)}

    slices = cut(_by_slice(done, tiles.means, named, "mean array<double>, vectors array<array<double>>"))
    tiles.tiles.unpersist()
    residual = np.sqrt(told["square"].to_numpy()) / max(theta[0], 1e-300)
    return WidePca(slices, theta, theta / max(total, 1e-300), residual, width)


def scores(features: DataFrame, model: WidePca, least_variance: float = 1e-12, rows: int = ROWS) -> DataFrame:
    """mask_id, coeffs: standardised scores, as cohort_model.scores; a component's part in a slice meets the tile of that slice."""
    features = features.filter("features is not null").select("mask_id", "features")
    told = features.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).first()
    if not told.n:
        return features.select(F.col("mask_id").cast("long").alias("mask_id"), F.lit(None).cast("array<double>").alias("coeffs"))
    k = len(model.variance)

    def packed(got: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(got["vectors"].iloc[0])
        return pd.DataFrame({"slice": got["slice"], "v": [np.ascontiguousarray(v.T).tobytes()], "m": [(np.asarray(got["mean"].iloc[0]) * told.n).tobytes()]})

    parts = model.slices.groupBy("slice").applyInPandas(packed, "slice long, v binary, m binary")
    tiles = _Tiles(features, told.n, told.width, rows, model.width, parts.select("slice", F.col("m").alias("v")))
    use = model.variance > least_variance * max(model.variance[:1].sum(), 1e-300)
    by = np.sqrt(np.where(use, model.variance, 1.0))
    ids = tiles.tiles.filter("slice = 0").select("block", "ids")

    def rows_of(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return _none("mask_id", "coeffs")
        c = _read(a["v"].iloc[0], k) / by
        return pd.DataFrame({"mask_id": b["ids"].iloc[0], "coeffs": [[float(v) if u else None for v, u in zip(r, use, strict=True)] for r in c]})

    return tiles.times(parts.select("slice", "v"), k).groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(rows_of, "mask_id long, coeffs array<double>")
