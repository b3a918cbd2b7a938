"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors become one class first. A vector o of unit length is rotated by random orthogonal matrices; the signs of the coordinates are its code. The signs
of one rotation, scaled to unit length, form a vector s with <s, o> = f, which is stored: <s, q> / f estimates <o, q>
without bias, and with high probability within EPSILON * sqrt((1 - f^2) / (f^2 (d - 1))). Groups of code bits are the
keys of hash tables. In a bucket the estimates, from codes and coarsely rounded rotated vectors, tell which
vectors may have a partner; for these alone the vectors themselves are fetched, and the pairs that the bounds keep are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import deal, large_groups, run_blocks
from larkspur.llm.components import connected_components
from larkspur.llm.names import col
from larkspur.llm.storage import drop_table, table_bytes, write_table
from larkspur.llm.wordhash import mix, small_batches, tidy

#: Standard deviations that the bound allows for, vectors of a bucket in one block, and the seed of the rotations.
EPSILON, BLOCK, SEED = 4.0, 512, 20240611
#: Levels of a rounded coordinate; it is within half a step of the true one.
LEVELS = 255
#: Unrelated vectors in a bucket, about.
BUCKET = 128


def plan_tables(n: int, threshold: float, recall: float = 0.995) -> tuple[int, int]:
    """Bits of a key, and tables: buckets of about BUCKET of n unrelated vectors, and enough tables that a pair at the threshold is missed with a chance of 1 - recall."""
    bits = min(32, max(6, math.ceil(math.log2(max(2, n / BUCKET)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


def rotations(dim: int, count: int) -> np.ndarray:
    """count random orthogonal matrices (count x dim x dim)."""
    rng = np.random.default_rng([SEED, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def unit_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By dimension: the positions of the valid vectors (finite, not zero, no nulls) of a list column, and the vectors in double precision, of unit length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    flat = np.asarray(values.cast(pa.float64()).fill_null(float("nan")) if values.null_count or not pa.types.is_float64(values.type) else values)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = flat[starts[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]


def encode(df: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, v) to (id, dim, keys, coded): the key in each table, and f, the signs of the first rotation and its rounded coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in small_batches(batches, 4096):
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for at, x in unit_vectors(b.column("v")):
                dim = x.shape[1]
                if dim not in made:
                    made[dim] = rotations(dim, max(1, -(-bits * tables // dim)))
                turned = np.einsum("nd,rde->nre", x, made[dim], optimize=True)
                signs = (turned > 0).reshape(len(x), -1)[:, : bits * tables].reshape(len(x), tables, bits)
                keys = mix((signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) ^ mix(np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20)))
                coded = codes(turned[:, 0, :])
                ends = np.arange(len(x) + 1, dtype=np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends * tables), pa.array(keys.view(np.int64).ravel()))
                coded = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends * coded.shape[1]), pa.py_buffer(np.ascontiguousarray(coded))])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array(np.full(len(x), dim, np.int32)), keys, coded], names=["id", "dim", "keys", "coded"])

    return df.mapInArrow(tidy(run), "id long, dim int, keys array<long>, coded binary")


def codes(turned: np.ndarray) -> np.ndarray:
    """Rotated unit vectors as rows of bytes: f and the largest coordinate (32-bit floats), the signs, the rounded coordinates."""
    dim = turned.shape[1]
    f, top = np.abs(turned).sum(axis=1) / math.sqrt(dim), np.abs(turned).max(axis=1)
    rounded = np.rint((turned / top[:, None] + 1) * (LEVELS / 2)).astype(np.uint8)
    return np.concatenate([np.stack([f, top], axis=1).astype("<f4").view(np.uint8), np.packbits(turned > 0, axis=1), rounded], axis=1)


def may_pair(coded_a: np.ndarray, coded_b: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Which pairs of codes (rows of bytes) have an upper bound of at least the threshold, from either vector's code."""

    def read(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        f, top = raw[:, :8].copy().view("<f4").astype(np.float32).T
        size = (dim + 7) // 8
        signs = np.unpackbits(raw[:, 8 : 8 + size], axis=1, count=dim).astype(np.float32) * 2 - 1
        return f, top, signs / np.float32(math.sqrt(dim)), (raw[:, 8 + size :].astype(np.float32) * np.float32(2 / LEVELS) - 1) * top[:, None]

    fa, ta, sa, qa = read(coded_a)
    fb, tb, sb, qb = (fa, ta, sa, qa) if coded_b is coded_a else read(coded_b)
    wide = lambda f: EPSILON * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, dim - 1)))
    # Rounding moves <s, q> by at most half a step for each coordinate, in units of 1 / sqrt(dim).
    slack = lambda t, f: t[None, :] / LEVELS * math.sqrt(dim) / f[:, None]
    upper_a = sa @ qb.T / fa[:, None] + wide(fa)[:, None] + slack(tb, fa)
    upper_b = upper_a if coded_b is coded_a else sb @ qa.T / fb[:, None] + wide(fb)[:, None] + slack(ta, fb)  # rows are b's
    return np.minimum(upper_a, upper_b.T) >= threshold - 1e-6


def _by_dim(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: positions and codes. A bucket has one, but for a clash of keys."""
    dims = t.column("dim").to_numpy()
    raw = t.column("coded").to_pylist()
    return {d: (at := np.flatnonzero(dims == d), np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1)) for d in np.unique(dims).tolist()}


def _dot_pairs(x: np.ndarray, y: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that may holds, and their products: pair by pair if they are few, else by a product of blocks."""
    i, j = np.nonzero(may)
    if 8 * len(i) > may.size:
        return i, j, (x @ y.T)[i, j]
    return i, j, np.concatenate([np.einsum("nd,nd->n", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)


def valid(v: str) -> str:
    """SQL: whether a vector has elements, all of them finite, and not all zero."""
    return f"coalesce(size({v}) > 0 and forall({v}, x -> x is not null and abs(cast(x as double)) < double('infinity')) and exists({v}, x -> x <> 0), false)"


def find_links(rows: DataFrame, *, threshold: float = 0.95, recall: float = 0.995, broadcast_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """rows: (id, copies, v), distinct vectors and how many each stands for. (id, n) per vector with links: how many others it links with; and edges (a, b) with the same components as the links.

    Buckets over BLOCK vectors are cut into blocks, each pair of blocks a unit of its own, so no task holds a whole bucket. Only
    counts, spanning edges and marks leave a block: their number grows with the vectors, not with the pairs. A pair that
    shares several buckets is counted in the first of its tables.
    """
    bits, tables = plan_tables(rows.count(), threshold, recall)
    coded = write_table(encode(rows.select("id", "v"), bits, tables), "codes")
    entries = coded.select("id", "dim", "coded", F.lit(True).alias("rest"), F.explode("keys").alias("key"))

    def mark(key: int, a: pa.Table, b: pa.Table | None) -> list[np.ndarray] | None:
        x, y = _by_dim(a), _by_dim(b) if b is not None else None
        out = []
        for dim, (at, codes_a) in x.items():
            if y is not None and dim not in y:
                continue
            may = may_pair(codes_a, codes_a if y is None else y[dim][1], dim, threshold)
            if y is None:
                np.fill_diagonal(may, False)
            out.append(a.column("id").to_numpy()[at[may.any(axis=1)]])
            if y is not None:
                out.append(b.column("id").to_numpy()[y[dim][0][may.any(axis=0)]])
        ids = np.concatenate(out) if out else np.zeros(0, np.int64)
        return [np.full(len(ids), key), ids]

    marked = run_blocks(deal(entries, large_groups(entries, BLOCK, broadcast_bytes)), ["id", "dim", "coded"], mark, "key long, id long")
    marked = write_table(marked.distinct(), "marked")
    # The rest of the work is on marked vectors only: the pairs within the bounds, with all keys to tell the first common table.
    wanted = write_table(marked.select("id").distinct(), "marked-ids")
    small = F.broadcast(wanted) if table_bytes(wanted) <= broadcast_bytes else wanted
    vectors = write_table(rows.join(small, "id", "left_semi").join(coded, "id"), "marked-vectors")
    again = marked.join(vectors, "id").withColumn("rest", F.lit(True))

    def count(key: int, a: pa.Table, b: pa.Table | None) -> list[np.ndarray] | None:
        unit = lambda t: {x.shape[1]: (at, x) for at, x in unit_vectors(t.column("v"))}
        codes_a, vectors_a = _by_dim(a), unit(a)
        codes_b, vectors_b = (codes_a, vectors_a) if b is None else (_by_dim(b), unit(b))
        kinds, ids, values = [], [], []
        for dim, (at, x) in vectors_a.items():
            if dim not in vectors_b:
                continue
            to, y = vectors_b[dim]
            may = may_pair(codes_a[dim][1], codes_a[dim][1] if b is None else codes_b[dim][1], dim, threshold)
            if b is None:
                may &= ~np.tri(len(may), dtype=bool)  # each pair once
            i, j, cosine = _dot_pairs(x, y, may)
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            if not len(i):
                continue
            other = a if b is None else b
            keys = lambda t, rows: np.asarray(t.column("keys").combine_chunks().flatten()).reshape(t.num_rows, -1)[rows]
            ka, kb = keys(a, at), keys(other, to)
            for k in range(ka.shape[1]):
                # Tables before this one: pairs that share them are counted there.
                if (ka[:, k] == key).all() and (kb[:, k] == key).all():
                    break
                apart = ka[i, k] != kb[j, k]
                i, j = i[apart], j[apart]
            id_a, id_b = a.column("id").to_numpy()[at], other.column("id").to_numpy()[to]
            copies_a, copies_b = a.column("copies").to_numpy()[at], other.column("copies").to_numpy()[to]
            for here, n in ((id_a, np.bincount(i, copies_b[j], len(id_a))), (id_b, np.bincount(j, copies_a[i], len(id_b)))):
                some = np.flatnonzero(n)
                kinds.append(np.zeros(len(some), np.int32))
                ids.append(here[some])
                values.append(n[some].astype(np.int64))
            # Labels spread over the links until each component has one.
            names, place = np.unique(np.concatenate([id_a[i], id_b[j]]), return_inverse=True)
            s, d = place[: len(i)], place[len(i) :]
            label = np.arange(len(names))
            while True:
                least = np.minimum(label[s], label[d])
                new = label.copy()
                np.minimum.at(new, s, least)
                np.minimum.at(new, d, least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            far = np.flatnonzero(label != np.arange(len(names)))
            kinds.append(np.ones(len(far), np.int32))
            ids.append(names[far])
            values.append(names[label[far]])
        return [np.concatenate(x) for x in (kinds, ids, values)] if ids else None

    dealt = deal(again, large_groups(again, BLOCK, broadcast_bytes))
    found = write_table(run_blocks(dealt, ["id", "dim", "copies", "v", "keys", "coded"], count, "kind int, id long, value long"), "link-counts")
    for t in (coded, marked, wanted, vectors):
        drop_table(t)
    counts = found.where("kind = 0").groupBy("id").agg(F.sum("value").alias("n"))
    return counts, found.where("kind = 1").select(F.col("id").alias("a"), F.col("value").alias("b")).distinct()


def dedup(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995) -> DataFrame:
    """One row per id: id, n_links (vectors linked directly), component_id (least id reachable), kept (id = component_id).

    Vectors link at a cosine of at least the threshold, in double precision. Null, zero and empty vectors and those with null or non-finite
    components link with nothing; neither do vectors of different lengths. If an id repeats, its least vector counts. A null id
    has no links, a null component and is not kept. Equal vectors are told by two 64-bit hashes, and compared as one with the others.
    """
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v"))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = write_table(rows.groupBy("id").agg(F.min("v").alias("v")), "one-vector-an-id")
    hashes = [F.xxhash64("v"), F.xxhash64(F.lit("second"), "v")]
    of = rows.where("id is not null").where(valid("v")).select("id", hashes[0].alias("h"), hashes[1].alias("g"))
    classes = write_table(of.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    first = classes.select(F.col("rep").alias("id"), "copies")
    distinct = write_table(rows.join(F.broadcast(first) if table_bytes(classes) <= 16 << 20 else first, "id"), "distinct-vectors")
    counts, edges = find_links(distinct, threshold=threshold, recall=recall)
    parts = connected_components(edges)
    known = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = write_table(known.select("h", "g", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")), "class-links")
    out = rows.where("id is not null").select("id", F.when(F.expr(valid("v")), hashes[0]).alias("h"), F.when(F.expr(valid("v")), hashes[1]).alias("g"))
    known = F.broadcast(known) if table_bytes(known) <= 16 << 20 else known
    out = out.join(known, ["h", "g"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    none = rows.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(none).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
