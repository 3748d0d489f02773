"""The most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs
and a Walsh-Hadamard transform) and assigned to the nearest signed axis. Every
row is indexed in one bucket of each table; a query also probes the next nearest
axes. How many axes make a bucket follows from the number of rows, and how many
tables from the collisions of sample vectors at the cosine looked for.

A bucket gets each of its vectors once, as a coarse code of 4 or 8 bits an
element with the length of its error, packed with others by the task that sends
it. The error bounds the cosine from both sides, so a bucket passes on every
candidate that may be among the best and none is lost to the coding. Candidates
are merged over buckets and reranked with the exact vectors. A query that has
more than :data:`MOST_OPEN` possible candidates in a bucket (a dense cluster) is
answered there from exact vectors instead, ``k`` + 1 candidates a block.

Copies (equal unit vectors) are one class with one representative in the index;
their members are put back at the end, at most ``k`` for each list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.tables import arrow_batches, broadcast_if_small, cut

#: Decimals to which cosines are compared; what is equal then is ordered by id.
DECIMALS = 6
#: Rows or queries of a bucket that one task multiplies at a time.
BLOCK = 8192
#: Candidates a query passes on from a bucket by its code; beyond, exact vectors decide.
MOST_OPEN = 128
#: Cosine from which codes of 4 bits are fine enough to tell candidates.
COARSE_FROM = 0.7

UNITS = "entity_id string, asks boolean, dim int, c1 long, c2 long, unit binary, code binary, near binary"
COUNTS = "dim int, bucket long, n_b long, n_q long"
PIECES = "dim int, bucket long, ids binary, codes binary, n_b int, n_q int, names array<string>"
HITS = "q long, b long, low float, high float, bucket long, dim int"
EXACT = "q long, b long, cos double, name string"
PAIRS = "a long, b long, cos double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row (a power of two wide)."""
    rows, n = x.shape
    step = 1
    while step < n:
        y = x.reshape(rows, -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n, dtype=x.dtype)


def rotated(unit: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-random rotation of the rows, padded to a power of two."""
    n = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), n), np.float32)
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, n))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` nearest signed axes of each row, nearest first, and how near.

    The second half of all axes are the opposites of the first, far side last.
    """
    n = x.shape[1]
    size = np.abs(x)
    k = min(m, n)
    at = np.argpartition(-size, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), x.shape)
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(size, at, 1), axis=1, kind="stable"), 1)
    value = np.take_along_axis(x, at, 1)
    out, near = at * 2 + (value < 0), np.abs(value)
    if m > n:
        rest = min(m, 2 * n) - n
        out = np.concatenate([out, (out ^ 1)[:, ::-1][:, :rest]], axis=1)
        near = np.concatenate([near, -near[:, ::-1][:, :rest]], axis=1)
    return out, near


def buckets(unit: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """Bucket numbers of each row in a table, the own one first, then probes.

    With several functions a bucket is a combination of axes; combinations are
    probed in the order of the sum of what they lose against the nearest.
    """
    number, loss = None, None
    for f in range(functions):
        x = rotated(unit, 1000 * table + f)
        at, near = axes(x, probes)
        at, lost = at.astype(np.int64), near[:, :1] - near
        if number is None:
            number, loss = at, lost
        else:
            number = (number[:, :, None] * (2 * x.shape[1]) + at[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(len(unit), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            number, loss = np.take_along_axis(number, order, 1), np.take_along_axis(loss, order, 1)
    return number


@cache
def tables_for(dim: int, functions: int, probes: int, cosine: float, recall: float) -> int:
    """Tables in which two vectors at ``cosine`` meet with probability ``recall``.

    The chance of one table is measured on 2 000 random pairs of that cosine.
    """
    rng = np.random.default_rng(dim)
    x, y = rng.normal(size=(2, 2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y
    probed = buckets(x.astype(np.float32), 1 << 20, functions, probes)
    met = (probed == buckets(y.astype(np.float32), 1 << 20, functions, 1)).any(1).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(met, 0.01), 0.999))))


def functions_for(rows: int, dim: int, block: int = BLOCK) -> int:
    """Functions a bucket combines so that it holds four blocks of rows at most, on average."""
    axes_of, functions = 2 << max(1, (dim - 1).bit_length()), 1
    while rows / axes_of**functions > 4 * block:
        functions += 1
    return functions


def encoded(unit: np.ndarray, bits: int) -> np.ndarray:
    """Each row as bytes: scale and length of the error (float32), then the elements."""
    most = (1 << bits - 1) - 1
    scale = np.abs(unit).max(1).astype(np.float32) / most
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1).astype(np.float32)
    if bits == 4:
        q = np.pad(q, ((0, 0), (0, q.shape[1] % 2))) + 8
        q = q[:, ::2] << 4 | q[:, 1::2]
    return np.concatenate([np.stack([scale, error], 1).view(np.uint8), q.view(np.uint8)], axis=1)


def decoded(codes: np.ndarray, dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse vectors of codes and the lengths of their errors."""
    both = np.ascontiguousarray(codes[:, :8]).view(np.float32)
    q = codes[:, 8:]
    if bits == 4:
        q = np.stack([q >> 4, q & 15], axis=2).reshape(len(q), -1)[:, :dim].astype(np.int8) - 8
    else:
        q = q.view(np.int8)
    return q.astype(np.float32) * both[:, :1], both[:, 1]


def code_bits(least: float) -> int:
    return 4 if least >= COARSE_FROM else 8


def _units(layout, bits: int):
    """Unit vectors with hash, code and buckets, ``layout`` giving (tables, functions, probes) of a dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, f in frame.groupby("dimension"):
                v = np.stack(f.embedding.to_numpy()).astype(np.float64)
                v /= np.abs(v).max(1, keepdims=True)  # neither overflow nor underflow of the norm
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                exact = np.rint(v * 10**DECIMALS).astype(np.int32)
                c = np.array([np.frombuffer(hashlib.blake2b(r.tobytes(), digest_size=16).digest(), np.int64) for r in exact])
                unit, asks = v.astype(np.float32), f.asks.to_numpy(bool)
                tables, functions, probes = layout(int(dim))
                near = np.stack([buckets(unit, t, functions, probes if asks.any() else 1) * tables + t for t in range(tables)], axis=1)
                code = encoded(unit, bits)
                yield pd.DataFrame({
                    "entity_id": f.entity_id.to_numpy(), "asks": asks, "dim": int(dim), "c1": c[:, 0], "c2": c[:, 1], "unit": [r.tobytes() for r in unit],
                    "code": [r.tobytes() for r in code], "near": [(r if a else r[:, :1]).tobytes() for r, a in zip(near, asks)]})

    return run


def usable_vectors(vectors: DataFrame, queries: str, layout, bits: int) -> DataFrame:
    """One unit vector per entity_id (see :data:`UNITS`).

    Usable is an embedding that is not null, as long as ``dimension`` says, with
    finite elements that are not all zero. Of several usable rows of an id the
    least ordinal counts, then the least dimension and embedding.
    """
    ok = (
        F.col("entity_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimension"))
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    one = (
        vectors.filter(F.coalesce(ok, F.lit(False)))
        .groupBy("entity_id").agg(F.min(F.struct("ordinal", "dimension", "embedding")).alias("v"))
        .select("entity_id", "v.*")
    )
    asking = one.select("entity_id", "dimension", "embedding", F.coalesce(F.expr(queries), F.lit(False)).alias("asks"))
    return asking.mapInPandas(_units(layout, bits), UNITS).withColumn("no", F.monotonically_increasing_id())


def classes_of(units: DataFrame, k: int) -> DataFrame:
    """Classes of copies: dim, c1, c2, no, name, asks, code, near, members.

    ``members`` holds the first ``k`` + 1 ids in order, each with whether it
    asks; the limit comes before the shuffle, so of a class that holds a third
    of all rows each task passes on no more. ``no`` is that of a member that asks
    if one does, ``name`` the least id. A class of more than ``k`` members does not
    ask, since its members fill their lists among themselves.
    """
    w = Window.partitionBy("dim", "c1", "c2").orderBy("entity_id")
    return (
        units.select("dim", "c1", "c2", "entity_id", "asks", "no", "code", "near").withColumn("n", F.row_number().over(w)).filter(f"n <= {k + 1}")
        .groupBy("dim", "c1", "c2").agg(
            F.min(F.struct((~F.col("asks")).alias("silent"), "entity_id", "no", "code", "near")).alias("r"),
            F.array_sort(F.collect_list(F.struct("entity_id", "asks"))).alias("members"))
        .select("dim", "c1", "c2", "r.no", F.element_at("members", 1)["entity_id"].alias("name"), (~F.col("r.silent") & (F.size("members") <= k)).alias("asks"), "r.code", "r.near", "members")
    )


def _placed(frame: pd.DataFrame, tables_of):
    """(dim, frame, keys, rows, probe) of each dimension: one entry for every vector in a bucket."""
    for dim, f in frame.groupby("dim"):
        tables = tables_of(int(dim))
        asks = f.asks.to_numpy(bool)
        # A member may carry probes though its class does not ask.
        near = [np.frombuffer(b, np.int64).reshape(tables, -1) for b in f.near]
        own = np.stack([x[:, 0] for x in near])
        keys, rows = [own.ravel()], [np.repeat(np.arange(len(f)), tables)]
        if asks.any() and (some := [near[i][:, 1:].ravel() for i in np.flatnonzero(asks)])[0].size:
            keys += some
            rows.append(np.repeat(np.flatnonzero(asks), len(some[0])))
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        probe = np.arange(len(keys)) >= own.size
        yield int(dim), f, asks, keys, rows, probe


def _counting(tables_of):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, _, asks, keys, rows, probe in _placed(frame, tables_of):
                bucket, at = np.unique(keys, return_inverse=True)
                yield pd.DataFrame({"dim": dim, "bucket": bucket, "n_b": np.bincount(at, ~probe).astype(np.int64), "n_q": np.bincount(at, asks[rows]).astype(np.int64)})

    return run


def _packing(tables_of, exact: bool):
    """Vectors of each bucket as one piece of a batch: rows first, then probes."""
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, f, asks, keys, rows, probe in _placed(frame, tables_of):
                order = np.lexsort((probe, keys))
                keys, rows, probe = keys[order], rows[order], probe[order]
                ids = ((f.no.to_numpy(np.int64) << 1) | asks)[rows].tobytes()
                codes = np.frombuffer(b"".join(f.unit if exact else f.code), np.uint8).reshape(len(f), -1)
                width, names = codes.shape[1], f.name.to_numpy()[rows] if exact else None
                codes = codes[rows].tobytes()
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                ends = np.r_[starts[1:], len(keys)]
                n_q = np.add.reduceat(probe.astype(np.int64), starts)
                yield pd.DataFrame([
                    (dim, keys[s], ids[8 * s : 8 * e], codes[width * s : width * e], e - s - q, q, None if names is None else list(names[s:e]))
                    for s, e, q in zip(starts.tolist(), ends.tolist(), n_q.tolist())], columns=columns)

    return run


def possible(q: np.ndarray, q_error: np.ndarray, b: np.ndarray, b_error: np.ndarray, k: int, least: float):
    """Pairs that may be among the ``k`` best of their query, with bounds of their cosine.

    Yields (rows of q, rows of b, low, high). Of exact vectors u, v with coarse
    ones u', v' the product differs by at most |u - u'| + |u'| |v - v'|.
    """
    for i in range(0, len(q), 1024):
        s, e = q[i : i + 1024] @ b.T, q_error[i : i + 1024, None]
        margin = e + (1 + e) * b_error[None, :] + np.float32(1e-5)
        open_ = s + margin >= least
        rows = np.flatnonzero(open_.sum(1) > k)
        if len(rows):
            low = s[rows] - margin[rows]
            kth = np.partition(low, len(b) - k, axis=1)[:, len(b) - k]
            open_[rows] &= s[rows] + margin[rows] >= kth[:, None]
        at, to = np.nonzero(open_)
        s, margin = s[at, to], margin[at, to]
        yield at + i, to, s - margin, s + margin


def best_exact(q: np.ndarray, b: np.ndarray, names: np.ndarray, k: int, least: float):
    """The ``k`` best rows of ``b`` for each query by rounded cosine, then by name."""
    k = min(k, len(b))
    place = np.empty(len(b), np.int64)
    place[np.argsort(names)] = np.arange(len(b))
    for i in range(0, len(q), 1024):
        s = q[i : i + 1024].astype(np.float64) @ b.T
        key = np.rint(s * 10**DECIMALS).astype(np.int64) * (len(b) + 1) - place
        to = np.argpartition(-key, k - 1, axis=1)[:, :k]
        at = np.repeat(np.arange(len(s)), k)
        to = to.ravel()
        ok = s[at, to] >= least
        yield at[ok] + i, to[ok], np.round(s[at, to][ok], DECIMALS)


def _groups(frames: Iterator[pd.DataFrame]):
    """Consecutive pieces of one block of one bucket, in a stream sorted by them."""
    held, key = [], None
    for f in frames:
        for r in f.itertuples(index=False):
            k = (r.dim, r.bucket, r.i, r.j)
            if k != key:
                if held:
                    yield held
                held, key = [], k
            held.append(r)
    if held:
        yield held


def _vectors_of(pieces, exact: bool):
    """(ids, codes, names, base, ask) of all vectors in the pieces of a block."""
    ids = np.frombuffer(b"".join(p.ids for p in pieces), np.int64)
    codes = np.frombuffer(b"".join(p.codes for p in pieces), np.uint8).reshape(len(ids), -1)
    probe = np.concatenate([np.arange(p.n_b + p.n_q) >= p.n_b for p in pieces])
    role = np.repeat([p.role for p in pieces], [p.n_b + p.n_q for p in pieces])
    base, ask = ~probe & (role != 1), (ids & 1 == 1) & (role != 0)
    names = np.concatenate([np.asarray(p.names, object) for p in pieces]) if exact else None
    return ids >> 1, codes, names, base, ask


def _gathering(run, schema: str, rows: int = 20_000):
    """Frames of many rows from the columns that ``run`` yields for each block, since each frame costs a message."""
    names = [c.split()[0] for c in schema.split(", ")]

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        n = 0
        for columns in run(frames):
            held.append(columns)
            n += len(columns[0])
            if n >= rows:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*held))})
                held, n = [], 0
        if n:
            yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*held))})

    return gathered


def _comparing(k: int, least: float, bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pieces in _groups(frames):
            dim, bucket = pieces[0].dim, pieces[0].bucket
            ids, codes, _, base, ask = _vectors_of(pieces, False)
            if not base.any() or not ask.any():
                continue
            v, error = decoded(codes, dim, bits)
            q_ids, b_ids = ids[ask], ids[base]
            for at, to, low, high in possible(v[ask], error[ask], v[base], error[base], k + 1, least):
                other = q_ids[at] != b_ids[to]
                at, to, low, high = at[other], to[other], low[other], high[other]
                many = np.bincount(at, minlength=1) > MOST_OPEN
                ok = ~many[at]
                n, dense = int(ok.sum()), np.flatnonzero(many)
                yield q_ids[at[ok]], b_ids[to[ok]], low[ok], high[ok], np.zeros(n, np.int64), np.zeros(n, np.int32)
                if n := len(dense):
                    none = np.zeros(n, np.float32)
                    yield q_ids[dense], np.full(n, -1), none, none, np.full(n, bucket, np.int64), np.full(n, dim, np.int32)

    return run


def _answering(k: int, least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pieces in _groups(frames):
            ids, codes, names, base, ask = _vectors_of(pieces, True)
            if base.any() and ask.any():
                v = np.ascontiguousarray(codes).view(np.float32)
                q_ids, b_ids, b_names = ids[ask], ids[base], names[base]
                for at, to, cos in best_exact(v[ask], v[base], b_names, k + 1, least):
                    other = q_ids[at] != b_ids[to]
                    yield q_ids[at[other]], b_ids[to[other]], cos[other], b_names[to[other]]

    return run


def _in_blocks(pieces: DataFrame, full: DataFrame) -> DataFrame:
    """Pieces by bucket and block, sorted so; buckets that are not full are one block.

    Each piece of a full bucket goes as rows to one block of rows against all
    blocks of queries, and as queries to one block of queries against all of rows.
    """
    cells = """CASE WHEN s_b IS NULL THEN array(named_struct('role', 2, 'i', 0, 'j', 0)) ELSE concat(
        CASE WHEN n_b = 0 THEN array() ELSE transform(sequence(0, s_q - 1), j -> named_struct('role', 0, 'i', int(pmod(h, s_b)), 'j', j)) END,
        transform(sequence(0, s_b - 1), i -> named_struct('role', 1, 'i', i, 'j', int(pmod(h, s_q))))) END"""
    placed = pieces.join(full, ["dim", "bucket"], "left").withColumn("h", F.xxhash64("ids")).withColumn("c", F.explode(F.expr(cells)))
    return (
        placed.select("dim", "bucket", "c.i", "c.j", "c.role", "n_b", "n_q", "ids", "codes", "names")
        .repartition("dim", "bucket", "i", "j").sortWithinPartitions("dim", "bucket", "i", "j")
    )


def candidates(classes: DataFrame, units: DataFrame, k: int, least: float, tables_of, bits: int, block: int) -> DataFrame:
    """Pairs of classes that may be among the ``k`` best of one that asks: (a, b), a < b."""
    spark = classes.sparkSession
    arrow_batches(spark)
    points = classes.select("dim", "no", "name", "asks", "code", "near")
    full = (
        points.select("dim", "asks", "near").mapInPandas(_counting(tables_of), COUNTS)
        .groupBy("dim", "bucket").agg(F.sum("n_b").alias("n_b"), F.sum("n_q").alias("n_q")).filter(f"n_b > {block} OR n_q > {block}")
        .select("dim", "bucket", F.greatest(F.lit(1), F.ceil(F.col("n_b") / block)).cast("int").alias("s_b"), F.greatest(F.lit(1), F.ceil(F.col("n_q") / block)).cast("int").alias("s_q"))
    )
    full = broadcast_if_small(full)
    pieces = points.mapInPandas(_packing(tables_of, False), PIECES)
    hits = cut(_in_blocks(pieces, full).mapInPandas(_gathering(_comparing(k, least, bits), HITS), HITS))
    # What a query may hold is merged over its buckets: the k-th best lower bound decides.
    best = hits.filter("b >= 0").groupBy("q", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "b"))
    kth = F.max(F.when(F.col("n") == k, F.col("low"))).over(Window.partitionBy("q"))
    pairs = best.withColumn("n", rank).withColumn("kth", kth).filter("kth IS NULL OR high >= kth").select("q", "b")
    dense = hits.filter("b < 0").select("q", "dim", "bucket").distinct()
    if dense.limit(1).count():
        pairs = pairs.unionByName(_dense_pairs(points, units, dense, full, k, least, tables_of))
    return pairs.select(F.least("q", "b").alias("a"), F.greatest("q", "b").alias("b")).distinct()


def _dense_pairs(points: DataFrame, units: DataFrame, dense: DataFrame, full: DataFrame, k: int, least: float, tables_of) -> DataFrame:
    """Candidates of queries in dense buckets from exact vectors, ``k`` + 1 a block.

    All vectors of these buckets meet again; what their other queries find is
    found twice and merged.
    """
    exact = points.join(units.select("no", "unit"), "no")
    wanted = dense.select("dim", "bucket").distinct()
    pieces = exact.mapInPandas(_packing(tables_of, True), PIECES).join(broadcast_if_small(wanted), ["dim", "bucket"], "left_semi")
    found = _in_blocks(pieces, full).mapInPandas(_gathering(_answering(k, least), EXACT), EXACT).distinct()
    w = Window.partitionBy("q").orderBy(F.desc("cos"), "name")
    return found.withColumn("n", F.row_number().over(w)).filter(f"n <= {k}").select("q", "b")


def _products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for dim, f in frame.groupby("dim"):
            x, y = (np.frombuffer(b"".join(f[c]), np.float32).reshape(len(f), dim).astype(np.float64) for c in ("unit_a", "unit_b"))
            yield pd.DataFrame({"a": f.a.to_numpy(), "b": f.b.to_numpy(), "cos": (x * y).sum(1)})


def reranked(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    """Exact cosines of candidate pairs, of ``least`` or more, in both directions."""
    v = units.select("no", "dim", "unit")
    both = (
        pairs.join(v.select(F.col("no").alias("a"), "dim", F.col("unit").alias("unit_a")), "a")
        .join(v.select(F.col("no").alias("b"), F.col("unit").alias("unit_b")), "b")
    )
    exact = both.select("dim", "a", "b", "unit_a", "unit_b").mapInPandas(_products, PAIRS).filter(F.col("cos") >= least).withColumn("cos", F.round("cos", DECIMALS))
    return exact.select(F.explode(F.array(F.struct(F.col("a").alias("q"), "b", "cos"), F.struct(F.col("b").alias("q"), F.col("a").alias("b"), "cos"))).alias("p")).select("p.*")


def nearest(vectors: DataFrame, k: int = 10, least: float = -1.1, queries: str = "true", tables: int | None = None, functions: int | None = None, probes: int | None = None,
            block: int = BLOCK, recall: float = 0.998) -> DataFrame:
    """The ``k`` most similar entities of every entity that ``queries`` selects.

    Result: entity_id, neighbour, cos, rank (from 1). Only entities of the same
    dimension with a cosine of ``least`` or more count; cosines that are equal
    to six decimals are ordered by neighbour. Unit vectors that agree to six
    decimals are copies and have cosine 1. ``queries`` is a SQL condition on
    ordinal and entity_id; the whole table is indexed. Rows that are not usable
    neither ask nor answer; see :func:`usable_vectors`.

    Where they are not given, ``functions`` follows from the number of rows,
    ``probes`` are two axes of each function, and ``tables`` are as many as find
    a pair at cosine ``least`` (0.5 if that is lower) with probability ``recall``.
    """
    rows, bits, cosine = vectors.count(), code_bits(least), max(least, 0.5)

    def layout(dim: int) -> tuple[int, int, int]:
        f = functions or functions_for(rows, dim, block)
        p = probes or 2**f
        return tables or tables_for(dim, f, p, cosine, recall), f, p

    def tables_of(dim: int) -> int:
        return layout(dim)[0]

    arrow_batches(vectors.sparkSession)
    units = cut(usable_vectors(vectors, queries, layout, bits))
    classes = cut(classes_of(units, k))
    near = reranked(candidates(classes, units, k, least, tables_of, bits, block), units, least)
    others = (
        near.join(classes.filter("asks").select(F.col("no").alias("q")), "q")
        .join(classes.select(F.col("no").alias("b"), F.col("members.entity_id").alias("ids")), "b")
        .select("q", "cos", F.explode(F.slice("ids", 1, k)).alias("neighbour"))
        .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "neighbour"))).filter(f"n <= {k}")
        .groupBy("q").agg(F.collect_list(F.struct((-F.col("cos")).alias("far"), "neighbour")).alias("others"))
    )
    # Sorted by falling cosine and id; both parts hold their own best.
    entry = "struct<far:double,neighbour:string>"
    copies = F.transform(F.filter("ids", lambda x: x != F.col("entity_id")), lambda x: F.struct(F.lit(-1.0).alias("far"), x.alias("neighbour")))
    members = classes.join(others.withColumnRenamed("q", "no"), "no", "left").select(
        F.explode("members").alias("m"), F.col("members.entity_id").alias("ids"), "others").filter("m.asks").select("m.entity_id", "ids", "others")
    lists = members.select("entity_id", F.array_sort(F.concat(copies, F.coalesce("others", F.array().cast(f"array<{entry}>")))).alias("list"))
    # Members of a class beyond its first k + 1 have the first k as their list.
    large = classes.filter(F.size("members") > k).select("dim", "c1", "c2", F.col("members.entity_id").alias("ids"))
    rest = (
        units.filter("asks").select("dim", "c1", "c2", "entity_id").join(broadcast_if_small(large), ["dim", "c1", "c2"])
        .filter(F.col("entity_id") > F.element_at("ids", k + 1)).select("entity_id", copies.alias("list"))
    )
    return lists.unionByName(rest).select("entity_id", F.posexplode(F.slice("list", 1, k)).alias("p", "x")).select(
        "entity_id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cos"), (F.col("p") + 1).alias("rank"))


def similar_pairs(lists: DataFrame) -> DataFrame:
    """Unordered pairs (entity_a, entity_b) of which one lists the other."""
    return lists.select(F.least("entity_id", "neighbour").alias("entity_a"), F.greatest("entity_id", "neighbour").alias("entity_b")).distinct()


def lost_neighbours(found: DataFrame, exact: DataFrame) -> DataFrame:
    """For every query how many of its true neighbours were found and lost."""
    both = exact.select("entity_id", "neighbour").join(found.select("entity_id", "neighbour", F.lit(1).alias("hit")), ["entity_id", "neighbour"], "left")
    return both.groupBy("entity_id").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"), (F.count("*") - F.count("hit")).alias("n_lost"))
