"""Whitening of embeddings by an exact integer scatter.

Components become integers. Their sums and cross products, less a shift, are added up exactly; n X'X - SS' is formed in
integers of any size, and only then is it made floating-point and decomposed by eigh. So neither the order of rows and
tasks nor a mean far from zero changes a digit of the covariance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import released, stage

#: Components become floor(SCALE * c).
SCALE = 256
#: Bits of a digit, and rows that are multiplied at once: so many products of two digits add up exactly in a double.
DIGIT, ROWS = 20, 4096
#: Bits of the digits in which sums of tasks are added up.
LIMB = 31
COMPONENTS = 4


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(SCALE * c) of each component as long; beyond its range the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of longs as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def digits(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of the digits times 2^(DIGIT k), each a matrix of doubles; only the last one's may be negative, and no more digits than needed."""
    out, most = [], int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    while most >> DIGIT:
        out.append((x & ((1 << DIGIT) - 1)).astype(np.float64))
        x, most = x >> DIGIT, most >> DIGIT
    return [*out, x.astype(np.float64)]


def shifted(x: np.ndarray, shift: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """x - shift as weights and matrices of doubles that hold integers of at most DIGIT bits or so."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    if max(abs(low), abs(high), *(abs(int(s)) for s in shift)) < 1 << 61:
        return [(1 << (DIGIT * k), d) for k, d in enumerate(digits(x - shift))]
    # The difference may leave the longs: both are split.
    return [(1 << (DIGIT * k), d) for k, d in enumerate(digits(x))] + [(-(1 << (DIGIT * k)), d) for k, d in enumerate(digits(np.broadcast_to(shift, x.shape)))]


def scatter(x: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact sums of x - shift and of its cross products, as arrays of Python integers."""
    dims = x.shape[1]
    sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)
    for at in range(0, len(x), ROWS):
        parts = shifted(x[at : at + ROWS], shift)
        for w, d in parts:
            sums += w * d.sum(0).astype(np.int64).astype(object)
            for v, e in parts:
                products += (w * v) * (d.T @ e).astype(np.int64).astype(object)
    return sums, products


def _limbs(entries: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each entry's place, and its signed digits of LIMB bits that aren't 0."""
    for at, value in enumerate(entries):
        sign, rest, k = (-1 if value < 0 else 1), abs(int(value)), 0
        while rest:
            if digit := rest & ((1 << LIMB) - 1):
                yield at, k, sign * digit
            rest, k = rest >> LIMB, k + 1


def exact_scatter(fit: DataFrame, shift: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums and the cross products of fit's x - shift, exactly. To the driver come d (d + 3) / 2 numbers, however many rows."""
    dims = len(shift)
    upper = np.triu_indices(dims)

    @released
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims + len(upper[0]), object)
        for batch in batches:
            if batch.num_rows:
                sums, products = scatter(rows_of(batch.column(0)), shift)
                n, total = n + batch.num_rows, total + np.concatenate([sums, products[upper]])
        found = list(_limbs(np.concatenate([total, np.array([n], object)])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["at", "limb", "v"])

    parts = fit.select("x").mapInArrow(summed, "at long, limb long, v long")
    total = [0] * (dims + len(upper[0]) + 1)
    for r in parts.groupBy("at", "limb").agg(F.sum("v").alias("v")).toLocalIterator():
        total[r.at] += r.v << (LIMB * r.limb) if r.v >= 0 else -(-r.v << (LIMB * r.limb))
    products = np.zeros((dims, dims), object)
    products[upper] = products.T[upper] = np.array(total[dims:-1], object)
    return total[-1], np.array(total[:dims], object), products


def components(n: int, sums: np.ndarray, products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of the covariance, falling; their eigenvectors as columns; its trace. (n P - SS') / n^2, rounded once."""
    exact = n * products - np.outer(sums, sums)
    v = np.array([[int(c) / (n * n) for c in row] for row in exact], np.float64)
    values, vectors = np.linalg.eigh(v)
    trace = int(exact.trace()) / (n * n)
    return values[::-1][:most], vectors[:, ::-1][:, :most], trace


def _per_row(rows: DataFrame, body: Callable[[np.ndarray], dict[str, pa.Array]], schema: str) -> DataFrame:
    """rows with the columns that body makes of their x."""

    @released
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = body(rows_of(batch.column(batch.schema.get_field_index("x"))))
                kept = [c for c in batch.schema.names if c != "x"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made.values()], [*kept, *made])

    kept = rows.drop("x").schema
    return rows.mapInArrow(mapped, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], schema]))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: longs where they and their squares' sums fit, else Python integers."""
    far = max(abs(int(x.min())), abs(int(x.max()))) * n + max(abs(int(s)) for s in sums)
    return n * x - sums.astype(np.int64) if far * far * x.shape[1] < 1 << 63 else n * x.astype(object) - sums


def deviations(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of what centred gives; None where it is beyond a long."""
    return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


def whiten(rows: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """key, component (int, from 1), n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, as are those with another number of
    components than most rows have (of equally many, the larger number counts). The covariance is over each different
    integer vector once, so copies have no weight; each row, a repeated one too, gets its results. A component without
    variance (to rounding) has a null `whitened` and `identity_error` leaves it out; it is null if all are such, as is
    `explained` if the trace is 0. `deviation` is null beyond a long. Fewer dimensions than `most` give fewer components; an
    empty table gives an empty table. Columns beside the two named ones aren't read, so their names can't clash.

    Different vectors are found by a map-side and a shuffled aggregate, so a hot one meets once a task. The driver gets the
    d (d + 3) / 2 exact sums of d dimensions and solves one d x d eigenproblem, whatever the rows.
    """
    vector = F.col(f"`{column}`")
    ok = rows.filter(usable(vector)).select(F.col(f"`{key}`").alias("id"), integers(vector).alias("x"))
    ok = stage(ok, "integers")
    schema = f"`{key}` {ok.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = ok.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    ok = ok.filter(F.size("x") == common.dims)
    fit = stage(ok.select("x").distinct(), "fit")
    shift = np.array(fit.agg(F.min("x")).first()[0], np.int64)
    n, sums, products = exact_scatter(fit, shift)
    values, vectors, trace = components(n, sums, products, most)
    sums = sums + n * shift.astype(object)
    flat = ~(values > trace * len(shift) * np.finfo(float).eps)
    scaled = vectors / np.sqrt(np.where(flat, 1.0, values))
    count = len(values)

    def project(d: np.ndarray) -> pa.Array:
        w = (d.astype(np.float64) / n) @ scaled
        return pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), count).cast(pa.list_(pa.float64()))

    # covar_pop centres as it goes and merges tasks' centred sums.
    pairs = [(i, j) for i in range(count) for j in range(i, count) if not flat[i] and not flat[j]]
    error = None
    if pairs:
        w = _per_row(fit, lambda x: {"w": project(centred(x, n, sums))}, "w array<double>").select(*[F.col("w")[i].alias(f"w{i}") for i in range(count)])
        found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def result(x: np.ndarray) -> dict[str, pa.Array]:
        d = centred(x, n, sums)
        return {"w": project(d), "deviation": pa.array(deviations(d), pa.int64())}

    out = _per_row(ok, result, "w array<double>, deviation long")
    told = lambda v: F.lit(None if v is None else float(v)).cast("double")
    explained = F.array(*[told(v / trace if trace > 0 else None) for v in values])
    out = out.select("id", "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("component"))
    at = F.col("component") - 1
    whitened = F.when(~F.get(F.array(*[F.lit(bool(x)) for x in flat]), at), F.get("w", at))
    return out.select(F.col("id").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), F.get(explained, at).alias("explained"), told(error).alias("identity_error"))
