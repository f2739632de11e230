"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter.

Entries become integers x = floor(1024 * c) + 100000. The scatter n * sum(x xT) - S ST is an integer
matrix, n squared times the covariance, so its characteristic polynomial is known exactly: tasks
reduce the matrix to Hessenberg form modulo one prime each and give the polynomial's residues, which
are put together by Chinese remaindering. All roots are real. For such polynomials the number of roots
above a is the number of sign changes in the coefficients of p(t + a), multiple roots included, so
bisection with integers isolates the largest roots and then narrows them to hundreds of bits. The
components are the null spaces of the scatter less the root: inverse iteration in decimal arithmetic.

Everything that grows with the table runs in tasks: sums are exact partial sums, combined by Spark.
The driver holds matrices of d * d numbers, d being the length of a vector.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
#: Bits of the largest root that roots are narrowed to, and digits of the inverse iteration.
ROOT_BITS, DIGITS = 320, 110
_LIMB, _LIMBS_OF = 20, 40  # bits of a limb; entries below 2**_LIMB need one, others three
_FAR = float(1 << 60)  # entries beyond count as this
_WORD = 60


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not NULL and holds only finite entries, as array<double>."""
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("_v", F.col(column).cast("array<double>")).filter(F.col("_v").isNotNull() & ~bad)
    return rows.drop(column).withColumnRenamed("_v", column)


def _integers(column: pa.ListArray, d: int) -> np.ndarray:
    """floor(SCALE * c), a row per vector, without SHIFT (no sum of deviations depends on it)."""
    values = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -_FAR, _FAR).astype(np.int64)


def _exact_gram(y: np.ndarray) -> np.ndarray:
    """yT y with Python integers. Limbs are so short that sums of a chunk are exact in doubles."""
    d = y.shape[1]
    total = np.zeros((d, d), object)
    if not len(y):
        return total
    if -(1 << _LIMB) < y.min() and y.max() < 1 << _LIMB:
        for at in range(0, len(y), 8192):
            part = y[at:at + 8192].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    mask = (1 << _LIMB) - 1
    limbs = np.concatenate([y & mask, y >> _LIMB & mask, y >> _LIMBS_OF], axis=1).astype(np.float64)
    for at in range(0, len(y), 512):
        part = limbs[at:at + 512]
        gram = (part.T @ part).astype(np.int64).astype(object)
        for i in range(3):
            for j in range(3):
                total += gram[i * d:i * d + d, j * d:j * d + d] * (1 << _LIMB * (i + j))
    return total


def scatter(rows: DataFrame, column: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums S per dimension (without SHIFT) and n * sum(x xT) - S ST, exactly.

    A task gives one row for each cell of its own sums and word of the number; Spark adds the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = _integers(batch.column(0), d)
            n += len(y)
            gram += _exact_gram(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
        cells = [n, *sums.tolist(), *(gram[i, j] for i in range(d) for j in range(i + 1))]
        at, word, value = [], [], []
        for k, number in enumerate(cells):
            sign, rest, place = (-1 if number < 0 else 1), abs(int(number)), 0
            while rest:
                at.append(k)
                word.append(place)
                value.append(sign * (rest & ((1 << _WORD) - 1)))
                rest >>= _WORD
                place += 1
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(word, pa.int32()), pa.array(value, pa.int64())], ["at", "word", "value"])

    words = rows.select(column).mapInArrow(run, "at int, word int, value long")
    cells = [0] * (1 + d + d * (d + 1) // 2)
    for row in words.groupBy("at", "word").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value")).collect():
        cells[row["at"]] += int(row["value"]) << _WORD * row["word"]  # d * d cells at most
    n, sums = cells[0], cells[1:d + 1]
    out, k = np.zeros((d, d), object), d + 1
    for i in range(d):
        for j in range(i + 1):
            out[i, j] = out[j, i] = n * cells[k] - sums[i] * sums[j]
            k += 1
    return n, sums, out


def primes(bits: int) -> list[int]:
    """The largest primes under 2**31 whose product has more than ``bits`` bits."""
    small = np.arange(3, 46342, 2)
    small = small[[all(p % q for q in range(3, int(p**0.5) + 1, 2)) for p in small.tolist()]]
    out, have, p = [], 0, (1 << 31) + 1
    while have <= bits:
        p -= 2
        if (p % small != 0).all():
            out.append(p)
            have += p.bit_length() - 1
    return out


def residues(matrix: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo each prime, from the constant one on."""
    p = np.array(moduli, np.int64)
    k, d = len(p), len(matrix)
    a = np.stack([(matrix % m).astype(np.int64) for m in moduli])
    rows, wide = np.arange(k), p[:, None, None]
    for c in range(d - 2):
        # a pivot under the diagonal, brought to row c + 1 by a swap of rows and of columns
        r = c + 1 + np.argmax(a[:, c + 1:, c] != 0, axis=1)
        a[rows, r], a[rows, c + 1] = a[rows, c + 1].copy(), a[rows, r].copy()
        a[rows, :, r], a[rows, :, c + 1] = a[rows, :, c + 1].copy(), a[rows, :, r].copy()
        inverse = np.array([pow(int(x), -1, m) if x else 0 for x, m in zip(a[:, c + 1, c], moduli)], np.int64)
        u = a[:, c + 2:, c] * inverse[:, None] % p[:, None]
        a[:, c + 2:] = (a[:, c + 2:] - u[:, :, None] * a[:, c + 1, None, :] % wide) % wide
        a[:, :, c + 1] = (a[:, :, c + 1] + (a[:, :, c + 2:] * u[:, None, :] % wide).sum(axis=2)) % p[:, None]
    known = [np.ones((k, 1), np.int64)]
    column = p[:, None]
    for m in range(1, d + 1):
        last = known[-1]
        new = np.zeros((k, m + 1), np.int64)
        new[:, 1:] = last
        new[:, :m] = (new[:, :m] - a[:, m - 1, m - 1, None] * last % column) % column
        path = np.ones(k, np.int64)
        for i in range(1, m):
            path = path * a[:, m - i, m - i - 1] % p
            lower = known[m - i - 1]
            new[:, :m - i] = (new[:, :m - i] - (a[:, m - i - 1, m - 1] * path % p)[:, None] * lower % column) % column
        known.append(new)
    return known[-1]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, from the constant one on. The matrix is positive semidefinite: no
    coefficient exceeds (1 + trace / d) ** d. Primes are dealt to tasks."""
    d = len(matrix)
    bound = (2 + int(np.trace(matrix)) // d) ** d
    moduli = primes(bound.bit_length() + 1)
    sent = spark.sparkContext.broadcast(matrix.tolist())  # d * d numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(sent.value, object).reshape(d, d)
        for batch in batches:
            at = batch.column(0).to_pylist()
            if at:
                found = residues(own, [moduli[i] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["at", "residues"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, len(moduli) // 4))
    rows = spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "at long, residues array<long>").collect()
    product = 1
    for m in moduli:
        product *= m
    out = [0] * (d + 1)
    for row in rows:
        m = moduli[row["at"]]
        rest = product // m
        weight = rest * pow(rest % m, -1, m)
        for i, r in enumerate(row["residues"]):
            out[i] += weight * r
    out = [c % product for c in out]
    return [c - product if c > product // 2 else c for c in out]


def roots_above(coefficients: list[int], a: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only exceed a / 2**bits, multiple ones counted
    so often: the sign changes of the coefficients after a shift by a."""
    d = len(coefficients) - 1
    c = [x << bits * (d - i) for i, x in enumerate(coefficients)]
    if a:
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign_at(coefficients: list[int], a: int, bits: int) -> int:
    d, value = len(coefficients) - 1, 0
    for i in range(d, -1, -1):
        value = value * a + (coefficients[i] << bits * (d - i))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], above: int, wanted: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots with their multiplicities, falling, until ``wanted`` are covered.
    All roots are real and at most ``above``. Roots closer than the last bit count as one."""
    zeros = next(i for i, c in enumerate(coefficients) if c)
    coefficients = coefficients[zeros:]
    finest = max(ROOT_BITS - above.bit_length(), 1)
    out: list[tuple[Fraction, int]] = []

    def search(low: int, high: int, bits: int, n_low: int, n_high: int) -> None:
        """Roots in (low, high], of which there are n_low - n_high."""
        while True:
            if n_low == n_high or n_high >= wanted:
                return
            if n_low - n_high == 1 or (bits >= finest and high - low <= 1):
                break
            if high - low <= 1:
                low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            n = roots_above(coefficients, middle, bits)
            search(middle, high, bits, n, n_high)
            high, n_high = middle, n
        if n_low - n_high == 1:
            up, known = _sign_at(coefficients, high, bits), False
            while up and not known and (bits < finest or high - low > 1):
                if high - low <= 1:
                    low, high, bits = low << 1, high << 1, bits + 1
                middle = (low + high) // 2
                sign = _sign_at(coefficients, middle, bits)
                if sign == up:
                    high = middle
                elif sign:
                    low = middle
                else:
                    low = high = middle
                    known = True
            if not up:
                low = high
        out.append((Fraction(low + high, 2 << bits), n_low - n_high))

    if len(coefficients) > 1 and above > 0:
        search(0, above, 0, len(coefficients) - 1, 0)
    return out


def null_vectors(matrix: np.ndarray, root: Fraction, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors of the scatter's eigenspace of ``root``, by inverse iteration."""
    with decimal.localcontext() as context:
        context.prec = DIGITS
        number = decimal.Decimal
        d = len(matrix)
        shift = number(root.numerator) / number(root.denominator)
        a = np.array([[number(int(x)) for x in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= shift
        tiny = max(abs(x) for x in a.ravel()) * number(10) ** -(DIGITS - 10) or number(1)
        order = list(range(d))
        for c in range(d):
            r = max(range(c, d), key=lambda i: abs(a[i, c]))
            if r != c:
                a[[c, r]] = a[[r, c]]
                order[c], order[r] = order[r], order[c]
            if abs(a[c, c]) < tiny:
                a[c, c] = tiny
            if c + 1 < d:
                a[c + 1:, c] = a[c + 1:, c] / a[c, c]
                a[c + 1:, c + 1:] -= np.outer(a[c + 1:, c], a[c, c + 1:])

        def solve(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for i in range(1, d):
                x[i] -= a[i, :i].dot(x[:i])
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - (a[i, i + 1:].dot(x[i + 1:]) if i + 1 < d else 0)) / a[i, i]
            return x

        found: list[np.ndarray] = []
        start = np.random.default_rng(count)
        for _ in range(count):
            v = np.array([number(int(x)) for x in start.integers(1, 1 << 30, d)], object)
            for _ in range(3):
                v = solve(v)
                for _ in range(2):
                    for w in found:
                        v = v - w * v.dot(w)
                    v = v / v.dot(v).sqrt()
            found.append(v)
        out = [np.array([float(x) for x in v]) for v in found]
    return [v if v[np.argmax(np.abs(v))] > 0 else -v for v in out]


def fit(rows: DataFrame, column: str, components: int = COMPONENTS) -> dict | None:
    """n, d, sums, and for each component its vector, eigenvalue and share of the trace. Vectors of the
    commonest length (of two, the longer) are the fit list; None where there is none."""
    own = usable(rows, column).select(column)
    lengths = own.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    d = lengths[0]["d"]
    n, sums, matrix = scatter(own.filter(F.size(column) == d), column, d)
    trace = int(np.trace(matrix))
    vectors, roots = [], []
    if trace:
        polynomial = characteristic_polynomial(rows.sparkSession, matrix)
        for root, times in largest_roots(polynomial, trace, components):
            take = min(times, components - len(roots))
            if take > 0:
                vectors += null_vectors(matrix, root, take)
                roots += [root] * take
    return {"n": n, "d": d, "sums": sums, "vectors": np.array(vectors).reshape(-1, d),
            "eigenvalues": [float(r / n**2) for r in roots], "explained": [float(r / trace) for r in roots]}


def _projector(model: dict):
    """Function from integers (rows of vectors) to whitened rows."""
    mean = np.array([float(Fraction(s, model["n"])) for s in model["sums"]])
    weights = model["vectors"] / np.sqrt(model["eigenvalues"])[:, None] if len(model["vectors"]) else model["vectors"]
    return lambda y: (y - mean) @ weights.T


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n * x - S) ** 2) of each row, exactly; NULL beyond 38 digits."""
    far = max([n * max(abs(int(y.min())), abs(int(y.max()))) + max(map(abs, sums))]) if y.size else 0
    if far * far * max(y.shape[1], 1) < 1 << 63:
        return ((y * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((y.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 10**38 else None for v in exact]


def identity_error(rows: DataFrame, column: str, model: dict) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    k = len(model["vectors"])
    if not k:
        return None
    d, project = model["d"], _projector(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(_integers(batch.column(0), d))
            sums += w.sum(axis=0)
            gram += w.T @ w
        values = np.concatenate([sums, gram.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    parts = rows.select(column).mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(k + k * k)
    for row in parts.collect():  # k + k * k rows
        values[row["at"]] = row["value"]
    mean, gram = values[:k] / model["n"], values[k:].reshape(k, k) / model["n"]
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``rows`` without ``column`` and with n, deviation, whitened, explained and identity_error.

    Rows go whose vector is NULL, holds NULL or non-finite entries, or has another length than most
    vectors have. whitened has one number per component, components by falling eigenvalue; only those
    with an eigenvalue above zero exist, so equal vectors give an empty array. deviation is a
    decimal(38, 0), NULL beyond. Entries whose integer passes 2**60 count as that. Repeated rows count
    as often as they occur; ids and further columns, NULL or not, are kept, those with one of the new
    names replaced. An empty table gives an empty one.
    """
    new = T.StructType.fromDDL("n long, deviation decimal(38,0), whitened array<double>")
    rows = rows.drop(*[c for c in (*new.names, "explained", "identity_error") if c != column])
    kept = [c for c in rows.columns if c != column]
    model = fit(rows, column, components)
    own = usable(rows, column)
    own = own.filter(F.size(column) == model["d"]) if model else own.limit(0)
    own = own.select(*kept, column)
    d, n, sums = (model["d"], model["n"], model["sums"]) if model else (0, 0, [])
    project = _projector(model) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _integers(batch.column(len(kept)), d)
            w = project(y)
            values = [decimal.Decimal(v) if v is not None else None for v in _deviations(y, n, sums)]
            cut = pa.array(np.arange(len(y) + 1, dtype=np.int32) * w.shape[1])
            arrays = [pa.array(np.full(len(y), n)), pa.array(values, pa.decimal128(38, 0)),
                      pa.ListArray.from_arrays(cut, pa.array(w.ravel(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], *arrays], [*kept, *new.names])

    schema = T.StructType([*(own.schema[c] for c in kept), *new.fields])
    error = identity_error(own, column, model) if model else None
    return own.mapInArrow(run, schema).select(
        "*", F.array(*map(F.lit, model["explained"] if model else [])).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
