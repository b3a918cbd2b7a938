"""Joins documents whose word-shingle sets have a Jaccard similarity of at least 4/5, by parity sketches.

A sketch has one bit for each 64-bit hash: XOR-ing a set's shingles into it flips one bit for each, so the number of bits
(and of words of bits) in which two sketches differ is at most the sets' symmetric difference. Sets of n >= m shingles
that link differ in at most (n + m) / 9 <= n / 4 shingles. Sketches are cut into words by shingle hash, as many for each size band as
make words of two or three shingles, and a word is known by the XOR of its bits' hashes. By the pigeonhole principle, linked sketches
share one of the first D + 1 non-zero words of each, D = n // 4, in any order that is the same for all: these words are
the join keys.

Candidates are first held against dense sketches of n to 2 n bits (the longer one folded to the shorter's length): pairs whose Hamming distance
exceeds (n + m) / 9 can't link. What is left is verified with the shingle sets of the texts: first one pair of each document, then pairs that these left in different components.

The order puts shingles that many documents share last (words never mix the two kinds), so a common passage
becomes a key only of documents that consist of little else. Size bands double; a set within a fifth of the band's upper end also emits the
keys of the next, and a pair meets in the band of its larger set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import deal, large_groups, run_blocks
from larkspur.llm.components import connected_components
from larkspur.llm.names import col, others, quoted, unused
from larkspur.llm.storage import drop_table, table_bytes, write_table
from larkspur.llm.wordhash import mix, small_batches, tidy, windows, word_runs

N = 5
#: Sets under SMALL shingles have words of one shingle each.
SMALL = 16
#: Counters that find common shingles, and the documents (or share of all) that make a counter common.
COUNTER_BITS, COMMON, COMMON_SHARE = 22, 8, 1e-4
_COUNTER = np.uint64(64 - COUNTER_BITS)
#: Keys with at most this many sets give all pairs at once; those with more first give a star around one of HUBS sets, and a ring.
FEW, HUBS = 6, 8
#: Members of a group that are compared in one block.
BLOCK = 512
#: Keys of a bucket (about), which is what a task holds at once; sets whose keys a task remembers to have emitted; keys that it sends at once.
BUCKET_KEYS, SEEN, SENT_KEYS = 200_000, 100_000, 400_000
_SALT = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased): 5-word windows, or all words if there are fewer. Null: none."""
    for _, rows, words, _, first in word_runs(texts, lower=True):
        hashes, of = windows(words, first, N)
        for i in range(rows):
            yield np.unique(hashes[of[i] : of[i + 1]])


def set_ids(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return tuple(int(mix(shingles ^ k).sum(dtype=np.uint64).view(np.int64)) for k in _SALT[:2])


def _keys_of_band(shingles: np.ndarray, common: np.ndarray, words: int, take: int) -> tuple[np.ndarray, bool]:
    """The first `take` sketch words of a set, and whether it has so many. words: of the sketch, or 0 for a word for each shingle."""
    if words:
        at = shingles % np.uint64(words) + np.where(common, np.uint64(words), np.uint64(0))
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        value = np.bitwise_xor.reduceat(mix(shingles[order] ^ _SALT[2]), first)
        at = at[first][value != 0]
        value, common = value[value != 0], at >= words
        keys = mix(value ^ mix(at + np.uint64(words << 32)))
    else:
        keys = mix(shingles + _SALT[1])
    order = np.lexsort((keys, common))[:take]
    return keys[order], len(keys) >= take


def join_keys(shingles: np.ndarray, common_counters: np.ndarray) -> np.ndarray:
    """All join keys of a non-empty set."""
    n = len(shingles)
    common = common_counters[shingles >> _COUNTER]
    take = n // 4 + 1
    band = 0 if n < SMALL else n.bit_length() - 1
    found = []
    ends = SMALL if band == 0 else 2 << band
    bands = [band] if 5 * n < 4 * ends else [band, SMALL.bit_length() - 1 if band == 0 else band + 1]
    for b in bands:
        keys, enough = _keys_of_band(shingles, common, int(0.6 * (2 << b)) if b else 0, take)
        found.append(keys)
        if not enough:  # so few words that sharing one isn't certain: also the shingles themselves
            found.append(_keys_of_band(shingles, common, 0, take)[0] ^ np.uint64(b + 1))
    return np.concatenate(found)


def dense_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of 64 bits, or the power of two from the set's size on: bit h mod length flips for each shingle."""
    bits = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_link(n: int, sketch_n: bytes, m: int, sketch_m: bytes) -> bool:
    """Whether sets of n and m shingles with these dense sketches can have a similarity of 4/5."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    a, b = sorted((sketch_n, sketch_m), key=len)
    while len(b) > len(a):  # what flips bit i of the longer one flips bit i mod length of the shorter
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    return 9 * (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() <= n + m


def signatures(docs: DataFrame) -> DataFrame:
    """(id, text) to (counter, id, n, k1, k2, sketch): of each shingle set its size, hashes and dense sketch.

    Rows with counter are of no document: how often (n) a task saw shingles of counter `id`, for the few counters that stand out in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["counter", "id", "n", "k1", "k2", "sketch"]
        hits = np.zeros(1 << COUNTER_BITS, np.uint32)
        for b in small_batches(batches, 512):
            found = []
            for s in shingle_sets(b.column("text")):
                found.append((len(s), *set_ids(s), dense_sketch(s)))
                np.add.at(hits, s >> _COUNTER, 1)
            n, k1, k2 = (pa.array([x[i] for x in found], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([False] * len(found)), b.column("id"), n, k1, k2, pa.array([x[3] for x in found], pa.binary())], names=names)
        mean = float(hits.mean())
        at = np.flatnonzero(hits >= 2 + int(mean + 3 * mean**0.5))
        zero = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(at), pa.bool_()), pa.array(at.astype(np.int64)), pa.array(hits[at].astype(np.int64)), zero, zero, pa.array([b""] * len(at), pa.binary())], names=names)

    return docs.mapInArrow(tidy(run), "counter boolean, id long, n long, k1 long, k2 long, sketch binary")


def common_counters(sig: DataFrame, n_docs: int) -> np.ndarray:
    """The counters (first COUNTER_BITS bits of a shingle's hash) that many documents hit; at most 2 ** COUNTER_BITS come to the driver.

    This orders keys and nothing else: results don't depend on it.
    """
    found = sig.where("counter").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= max(COMMON, COMMON_SHARE * n_docs)).select("id").toPandas()["id"]
    out = np.zeros(1 << COUNTER_BITS, bool)
    out[found.to_numpy(np.int64)] = True
    return out


def _emit(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, keys, sets, sizes): join keys, packed by bucket. A task emits the keys of a set once, however many copies it reads."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.unpackbits(shared.value).astype(bool)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _, _ in held])
            counts = [len(k) for k, _, _ in held]
            sets = np.repeat(np.array([s for _, s, _ in held], np.int64), counts)
            sizes = np.repeat(np.array([n for _, _, n in held], np.uint32), counts)
            bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            cut = [*first.tolist(), len(order)]
            parts = [order[i:j] for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *[pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (keys, sets, sizes)]], names=["bucket", "keys", "sets", "sizes"])
            held.clear()

        for b in small_batches(batches, 512):
            for s in shingle_sets(b.column("text")):
                if not len(s) or (k := set_ids(s)[0]) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                held.append((join_keys(s, counters), k, len(s)))
                size += len(held[-1][0])
                if size > SENT_KEYS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(tidy(run), "bucket int, keys binary, sets binary, sizes binary")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, in order of their buckets, to candidates: (false, x, y, 0) for a pair, (true, x, group, size) for a set in a larger group. A task holds one bucket."""
    now, held = None, ([], [], [])
    groups: set[int] = set()
    for b in batches:
        buckets = b.column(0).to_numpy()
        for i in range(b.num_rows):
            if buckets[i] != now:
                yield from _meet_bucket(held, groups)
                now, held = buckets[i], ([], [], [])
            for k, t in enumerate((np.uint64, np.int64, np.uint32)):
                held[k].append(np.frombuffer(b.column(k + 1)[i].as_buffer(), t))
    yield from _meet_bucket(held, groups)


def _meet_bucket(read: tuple[list, list, list], groups: set[int]) -> Iterator[pa.RecordBatch]:
    """groups: names of the member lists that the task has handed on (at most SEEN: more are repeated, which does no harm)."""
    if not read[0]:
        return
    keys, sets, sizes = map(np.concatenate, read)
    order = np.lexsort((sets, keys))
    keys, sets, sizes = keys[order], sets[order], sizes[order].astype(np.int64)
    new = np.r_[True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])]
    keys, sets, sizes = keys[new], sets[new], sizes[new]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)])
    found: list[np.ndarray] = []

    def pair(x: np.ndarray, y: np.ndarray) -> None:
        fit = (sets[x] != sets[y]) & (5 * np.minimum(sizes[x], sizes[y]) >= 4 * np.maximum(sizes[x], sizes[y]))
        found.append(np.stack([sets[x[fit]], sets[y[fit]]], axis=1))

    for g in range(2, FEW + 1):
        at = first[counts == g]
        for i in range(g):
            for j in range(i + 1, g):
                # The lesser set's hash goes last, so a pair has one form.
                pair(at + j, at + i)
    for f, n in zip(first[counts > FEW].tolist(), counts[counts > FEW].tolist(), strict=True):
        ids = sets[f : f + n]
        name = int(mix(ids.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
        hub = f + int(np.argmin(mix(ids.view(np.uint64) ^ mix(np.full(n, int(keys[f]) % HUBS, np.uint64)))))
        pair(np.arange(f, f + n), np.full(n, hub))
        # And a ring in an order of the key's own: over its keys, a set meets many random members.
        ring = f + np.argsort(mix(ids.view(np.uint64) ^ keys[f]))
        x, y = ring, np.roll(ring, 1)
        pair(np.maximum(x, y), np.minimum(x, y))
        if name not in groups:
            if len(groups) >= SEEN:
                groups.clear()
            groups.add(name)
            yield _candidates(True, ids, np.full(n, name), sizes[f : f + n])
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    for i in range(0, len(pairs), 100_000):
        p = pairs[i : i + 100_000]
        yield _candidates(False, p[:, 0], p[:, 1], np.zeros(len(p), np.int64))


def _candidates(member: bool, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), member)), pa.array(x), pa.array(y), pa.array(n)], names=["member", "x", "y", "n"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles): the sorted shingle hashes of each text."""
    for b in small_batches(batches, 512):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())], names=["id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their shingles to those that link."""
    for b in small_batches(batches, 1024):
        keep = []
        for x, y in zip(b.column("shingles_a"), b.column("shingles_b"), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(shared > 0 and 100 * shared >= 80 * (len(s) + len(t) - shared))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, 4096):
        columns = [b.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b")]
        yield b.select(["a", "b"]).filter(pa.array([may_link(*x) for x in zip(*columns, strict=True)], pa.bool_()))


def _across(_: int, a: pa.Table, b: pa.Table | None) -> list[np.ndarray] | None:
    """Pairs of a group whose members are in different components and may link, by vectorised Hamming distances of dense sketches of equal length."""

    def by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        ids, n, c = (rows.column(x).to_numpy() for x in ("id", "n", "c"))
        sketches = rows.column("sketch").to_pylist()
        sizes = np.array([len(x) for x in sketches])
        found = {}
        for k in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == k)
            found[k] = (ids[at], n[at], c[at], np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1))
        return found

    x, y = by_length(a), by_length(a if b is None else b)
    out: list[np.ndarray] = []
    for p, (ids, n, c, words) in x.items():
        for q, (ids_q, n_q, c_q, words_q) in y.items():
            if not q / 2 <= p <= 2 * q or b is None and p > q:
                continue  # sizes of linked sets differ by a quarter at most, their sketches' lengths by a factor of two
            u = words[:, : q // 8] ^ words[:, q // 8 :] if p > q else words
            v = words_q[:, : p // 8] ^ words_q[:, p // 8 :] if q > p else words_q
            step = max(1, (1 << 21) // max(1, v.size))
            for i in range(0, len(ids), step):
                distance = np.bitwise_count(u[i : i + step, None, :] ^ v[None, :, :]).sum(axis=2, dtype=np.int64)
                m, k = n[i : i + step, None], n_q[None, :]
                may = (9 * distance <= m + k) & (5 * np.minimum(m, k) >= 4 * np.maximum(m, k)) & (c[i : i + step, None] != c_q[None, :])
                r, t = np.nonzero(may)
                s, d = ids[i + r], ids_q[t]
                out.append(np.stack([np.maximum(s, d), np.minimum(s, d)]))
    return list(np.unique(np.concatenate(out, axis=1), axis=1)) if out else None


def verify(pairs: DataFrame, docs: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """Those of pairs (a, b: ids) that link, written. Only the shingles of documents in pairs are shuffled, hashed once a document; b is the end that many pairs may share."""
    ids = write_table(pairs.select(F.col("a").alias("i")).unionAll(pairs.select(F.col("b").alias("i"))).distinct(), "pair-ids")
    wanted = F.broadcast(ids) if table_bytes(ids) <= broadcast_bytes else ids
    sets = write_table(docs.join(wanted, docs["id"] == wanted["i"], "left_semi").mapInArrow(tidy(_shingles), "id long, shingles binary"), "pair-shingles")
    a, b = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab")
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b")
    links = write_table(rows.mapInArrow(tidy(_verify), "a long, b long").distinct(), "links")
    drop_table(ids)
    drop_table(sets)
    return links


def verify_components(pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links among pairs (a, b) that give the components of all links among them, and these (id, component): a pair of each document is verified first, then those whose ends are in different components."""
    one = write_table(pairs.groupBy("a").agg(F.min("b").alias("b")), "first-pairs")
    links = verify(one, docs)
    # Repeated ids: all classes of one id are one document, so ids, not classes, are the vertices.
    joined = write_table(connected_components(links), "components")
    of = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    apart = pairs.join(one, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b"))
    rest = write_table(apart.select("a", "b"), "pairs")
    drop_table(one)
    if rest.limit(1).count():
        links = links.unionAll(verify(rest, docs))
        joined = write_table(connected_components(links), "components")
    drop_table(rest)
    return links, joined


def link_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, component_id) of every row, and the links (a, b) found between the least ids of different shingle sets.

    component_id: the least id reachable by links, itself included. Texts without words (null, blank) have n_shingles 0 and link with
    nothing. Rows with the same id are one document with several texts: each keeps its n_shingles, all have the same component. A row with a null id
    links with nothing.

    Equal sets become one class first (sums of minima: any number of copies). Links between classes in one key group of more than FEW are looked for in
    two rounds: with a hub of the group and along a ring, then between those members that the first round left in different components; pairs within one need
    no check, since only components are asked for. So a group of near copies costs its size, and no link is lost.
    """
    spark = df.sparkSession
    docs = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    tasks = write_table(signatures(docs), "signatures")
    sig = tasks.where("not counter").drop("counter")
    whole = docs.where("id is not null")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sig.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.floor(F.col("n") / 4) + 1), F.lit(0)).alias("keys")).first()
    # As many buckets as keep one small, and partitions as keep one under some ten MB, whatever the data.
    buckets = 1 << max(8, (max(4 * partitions, total["keys"] // BUCKET_KEYS) - 1).bit_length())
    packed = _emit(whole, common_counters(tasks, total["rows"]), buckets)
    met = packed.repartition(max(partitions, total["keys"] // (4 * BUCKET_KEYS)), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_meet), "member boolean, x long, y long, n long")
    candidates = write_table(met.distinct(), "candidates")
    classes = write_table(sig.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    sig = sig.drop("sketch")

    def screened(rows: DataFrame) -> DataFrame:
        return write_table(rows.where("a <> b").mapInArrow(tidy(_may_link), "a long, b long").distinct(), "pairs")

    end = lambda key, c: classes.select(F.col("k1").alias(key), *[F.col(x).alias(y) for x, y in (("rep", c), ("n", f"n_{c}"), ("sketch", f"sketch_{c}"))])
    pairs = screened(candidates.where("not member").select("x", "y").join(end("x", "a"), "x").join(end("y", "b"), "y").drop("x", "y"))
    links, joined = verify_components(pairs, whole)
    drop_table(pairs)
    members = candidates.where("member").select(F.col("y").alias("g"), F.col("x").alias("k1")).join(classes, "k1").join(joined, F.col("rep") == F.col("id"), "left")
    members = write_table(members.select("g", F.col("rep").alias("doc"), "n", "sketch", F.coalesce("component", "rep").alias("c")), "group-members")
    drop_table(candidates)
    # In a group, pairs with an end outside the component of most members; pairs within one need no check.
    parts = members.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size"))
    split = write_table(parts.groupBy("g").agg(F.max(F.struct("size", "c"))["c"].alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("g", "most"), "split-groups")
    left = members.join(split, "g").select(F.col("g").alias("key"), F.col("doc").alias("id"), "n", "sketch", "c", (F.col("c") != F.col("most")).alias("rest"))
    left = write_table(left, "open-members")
    across = run_blocks(deal(left, large_groups(left, BLOCK)), ["id", "n", "sketch", "c"], _across, "a long, b long")
    pairs = write_table(across.distinct().join(links, ["a", "b"], "left_anti"), "pairs")
    more = verify(pairs, whole)
    for t in (pairs, members, split, left):
        drop_table(t)
    links = links.unionAll(more)
    same_id = sig.where("n > 0 and id is not null").join(classes, ["n", "k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = write_table(connected_components(links.unionAll(same_id.where("a <> b"))), "components") if _repeats(sig) else None
    if found is None:
        found = write_table(connected_components(links), "components") if more.limit(1).count() else joined
        of = write_table(classes.join(found, F.col("rep") == F.col("id"), "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component")), "class-components")
        out = sig.join(of, ["n", "k1", "k2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    else:
        out = sig.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out, links


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The rows of df whose id is the least of its component, so one document of each group; of rows with one id, the least. Rows with a null id stay."""
    rows, _ = link_documents(df, id_col=id_col, text_col=text_col)
    gone_id, row = unused(df.columns, "gone", "row")
    gone = write_table(rows.where("id <> component_id").select(F.col("id").alias(gone_id)).distinct(), "duplicates")
    kept = df.join(F.broadcast(gone) if table_bytes(gone) <= broadcast_bytes else gone, col(id_col).cast("long") == col(gone_id), "left_anti")
    if not _repeats(rows):
        return kept
    rest = list(map(quoted, others(df.columns, [id_col])))
    one = kept.where(col(id_col).isNotNull()).groupBy(col(id_col)).agg(F.min(F.struct(*rest)).alias(row)).select(quoted(id_col), f"{quoted(row)}.*")
    return one.select(*map(quoted, df.columns)).unionAll(kept.where(col(id_col).isNull()))


def _repeats(sig: DataFrame) -> bool:
    """Whether an id occurs in more than one row."""
    return sig.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0
