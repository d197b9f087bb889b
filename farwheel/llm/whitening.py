"""Whitening of embeddings from an exact scatter in residue numbers.

Entries become integers x; the fit list is each distinct x-vector once, n of them with sums S. What is multiplied are the centred
integers n x - S. Every partition takes them modulo each of several primes and forms, a block of rows at a time, the
matrix product of the residues in double precision, which is exact: primes lie below 2^20 and a block has at most 4,096 rows, so no
sum reaches 2^53. The residues of a row of the matrix are added over partitions, and Chinese remaindering over as many
primes as the largest possible entry asks for gives the exact scatter, of which the covariance is the correctly rounded quotient by
n^3. Its eigenvectors come from a double-precision eigh on the driver, where one matrix of the vectors' length stands and no rows.

Vectors that are null or hold null or non-finite entries are dropped, empty ones too; a null vec_id is kept; repeated rows count once
in the fit and each has its rows in the result; vectors of another length are fitted for themselves; entries beyond a long's
range become its ends; ties of eigenvalues stand in eigh's order; components whose eigenvalue is nothing but rounding are
left out, as are those beyond a vector's length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farwheel.llm.shared import prepare, written

#: Rows of a block: with primes below 2^20 a block's sums stay under 2^53.
BLOCK, PRIME_BITS = 4096, 20
_LONG = (1 << 63) - 1


def primes(bound: int) -> list[int]:
    """The largest primes below 2^20 whose product exceeds 2 * bound, so that every |value| <= bound is told."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound:
        if all(p % q for q in range(3, 1 + int(p**0.5), 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def reconstruct(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """The integers of least size with these residues, a row for each modulus."""
    product = 1
    for p in moduli:
        product *= p
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    sums = (sum(w * int(r) for w, r in zip(weights, col, strict=True)) % product for col in residues.T)
    return [v - product if v > product // 2 else v for v in sums]


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """(length, x-vectors as rows, their batch, their places in it)."""
    for b in batches:
        x = b.column(column)
        lengths = x.value_lengths().to_numpy()
        flat, start = x.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)]
        for dim in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == dim)
            yield dim, flat[start[at][:, None] + np.arange(dim)], b, at


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>) of (vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sound = (F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("e", lambda c: F.floor(c * scale) + 0).alias("x"))


def sums(fit: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """n, the largest |x| and S by length. A partition sends a number for each place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[Any]] = {}
        for dim, x, _, _ in _blocks(batches, 0):
            n, high, low, least, most = seen.get(dim) or [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0, 0]
            seen[dim] = [n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), min(least, int(x.min())), max(most, int(x.max()))]
        rows = [(dim, i, n, int(h), int(w), least, most) for dim, (n, high, low, least, most) in seen.items() for i, (h, w) in enumerate(zip(high, low, strict=True))]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["dim", "i", "n", "high", "low", "least", "most"])

    got = fit.mapInArrow(add, "dim long, i long, n long, high long, low long, least long, most long").groupBy("dim", "i")
    total = got.agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")), F.min("least").alias("least"), F.max("most").alias("most"))
    out: dict[int, tuple[int, int, list[int]]] = {}
    for r in sorted(total.collect(), key=lambda r: (r.dim, r.i)):  # a row for each place of a vector
        n, size, s = out.get(r.dim, (r.n, 0, []))
        out[r.dim] = (n, max(size, -r.least, r.most), [*s, (int(r.high) << 32) + int(r.low)])
    return out


def scatter(fit: DataFrame, known: dict[int, tuple[int, int, list[int]]]) -> dict[int, np.ndarray]:
    """The covariance V by length: the exact sum of (n x - S)(n x - S)^T, over n^3, rounded once."""
    moduli = {dim: primes(n * (2 * n * size) ** 2) for dim, (n, size, _) in known.items()}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for dim, every, _, _ in _blocks(batches, 0):
            n, _, s = known[dim]
            for k in range(0, len(every), BLOCK):
                x = every[k : k + BLOCK]
                for p in moduli[dim]:
                    r = (x % p * (n % p) - np.array([v % p for v in s])) % p
                    product = (r.astype(np.float64).T @ r.astype(np.float64)).astype(np.int64)
                    held[dim, p] = (held.get((dim, p), 0) + product) % p
        rows = [(dim, p, i, m[i].tobytes()) for (dim, p), m in held.items() for i in range(dim)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["dim", "p", "i", "r"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        p = key[1].as_py()
        total = sum(np.frombuffer(r.as_py(), np.int64) for r in table.column("r")) % p
        return pa.table({"dim": [key[0].as_py()], "p": [p], "i": [key[2].as_py()], "r": [total.tobytes()]})

    def remainder(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        of = {p: np.frombuffer(r, np.int64) for p, r in zip(table.column("p").to_pylist(), table.column("r").to_pylist(), strict=True)}
        cube = known[dim][0] ** 3
        exact = reconstruct(np.stack([of[p] for p in moduli[dim]]), moduli[dim])
        return pa.table({"dim": [dim], "i": [key[1].as_py()], "v": [[e / cube for e in exact]]})

    parts = fit.mapInArrow(multiply, "dim long, p long, i long, r binary")
    reduced = parts.groupBy("dim", "p", "i").applyInArrow(add, "dim long, p long, i long, r binary")
    rows = reduced.groupBy("dim", "i").applyInArrow(remainder, "dim long, i long, v array<double>").collect()
    out = {dim: np.zeros((dim, dim)) for dim in known}
    for r in rows:
        out[r.dim][r.i] = r.v
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of a covariance, falling, their unit vectors as columns, and the trace."""
    e, u = np.linalg.eigh(v)
    keep = [k for k in np.argsort(-e, kind="stable")[:most] if e[k] > len(e) * np.finfo(float).eps * max(e[-1], 0.0) and e[k] > 0]
    u = u[:, keep]
    top = np.abs(u).argmax(0) if len(keep) else np.zeros(0, int)
    return e[keep], u * np.sign(u[top, np.arange(len(keep))]), float(np.trace(v))


def _deviation(x: np.ndarray, n: int, size: int, s: list[int]) -> list[int | None]:
    """sum (n x - S)^2 exactly; null beyond a long."""
    if len(s) * (2 * n * size) ** 2 <= _LONG:
        d = n * x - np.array(s, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(s, object)
    return [v if v <= _LONG else None for v in (d * d).sum(1).tolist()]


def whiten(vectors: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of (vec_id, embedding), for up to `most` components."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = written(integers(vectors, scale), "integers")
    fit = written(rows.select("x").distinct(), "fit")
    known = sums(fit)
    models = {dim: principal(v, most) for dim, v in scatter(fit, known).items()}
    shared = spark.sparkContext.broadcast((known, {d: (e, u) for d, (e, u, _) in models.items()}))  # lengths x components

    def project(dim: int, x: np.ndarray) -> np.ndarray:
        stats, axes = shared.value
        n, _, s = stats[dim]
        e, u = axes[dim]
        return (x - np.array([v / n for v in s])) @ u / np.sqrt(e)

    def total(shift: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        """The sums of the fit list's whitened vectors, or those of their centred products."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for dim, x, _, _ in _blocks(batches, 0):
                w = project(dim, x)
                if shift is not None:
                    w = w - shift[dim]
                held[dim] = held.get(dim, 0) + (w.sum(0) if shift is None else w.T @ w).ravel()
            out = [(dim, i, float(v)) for dim, m in held.items() for i, v in enumerate(m)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["dim", "i", "v"])

        got = fit.mapInArrow(add, "dim long, i long, v double").groupBy("dim", "i").agg(F.sum("v").alias("v")).collect()
        out: dict[int, np.ndarray] = {dim: np.zeros(len(models[dim][0]) ** (1 if shift is None else 2)) for dim in known}
        for r in got:  # at most `most` squared a length
            out[r.dim][r.i] = r.v / known[r.dim][0]
        return out

    covariance = total(total(None))
    errors = {dim: float(np.abs(c - np.eye(len(models[dim][0])).ravel()).max(initial=0.0)) for dim, c in covariance.items()}
    explained = {dim: (e / t).tolist() for dim, (e, _, t) in models.items()}

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, b, at in _blocks(batches, 1):
            n, size, s = known[dim]
            w = project(dim, x)
            k = w.shape[1]
            ids = b.column(0).take(pa.array(np.repeat(at, k)))
            far = [v for v in _deviation(x, n, size, s) for _ in range(k)]
            cols = [ids, pa.array(list(range(1, k + 1)) * len(x), pa.int32()), pa.array([n] * len(far), pa.int64()), pa.array(far, pa.int64()), pa.array(w.ravel()), pa.array(explained[dim] * len(x), pa.float64()), pa.array([errors[dim]] * len(far), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
