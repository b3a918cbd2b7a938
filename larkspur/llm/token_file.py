"""Token-id files of directly addressable codes.

An id is cut into chunks, the lowest bits first. Level 0 has a chunk of every id, level k one of each id that needs
more than k chunks. A continuation bit for each chunk says whether the id goes on, and a rank directory
counts the set bits before each block of BLOCK, so chunk i's place in the next level is a look-up and a count
over one block: any token is read without decoding others. The widths of the chunks are those that make the
blob shortest for its ids.

A file is a Parquet table in the shared folder; a row holds a blob of whole documents, about SEGMENT ids, and the rows
(by part, then segment) are in ascending document order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.bpe import Encoder, byte_characters, read_settings
from larkspur.llm.names import col
from larkspur.llm.storage import table_bytes, write_table
from larkspur.llm.wordhash import small_batches, tidy

MAGIC, BLOCK, SEGMENT = b"DAC1", 512, 1 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths that give the fewest bits: a shortest path over the bits from 0 to the longest id's length."""
    if ids.max(initial=0) < 1 << 20:
        distinct = np.bincount(ids)
        of = np.flatnonzero(distinct)
        lengths = np.bincount(np.maximum(1, np.frexp(of.astype(float))[1]), distinct[of], 2)
    else:
        lengths = np.bincount(np.maximum(1, np.frexp(ids.astype(float))[1]), minlength=2)
    longer = np.r_[lengths[::-1].cumsum()[::-1], 0]  # longer[b]: ids of at least b bits
    top = len(lengths) - 1
    cost: list[tuple[float, list[int]]] = [(0.0, [])]
    for end in range(1, top + 1):
        cost.append(min((cost[b][0] + longer[b + 1 if b else 0] * (end - b + (end < top)), [*cost[b][1], end - b]) for b in range(end)))
    return cost[top][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    used = (width + 7) // 8
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :used])
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    raw = np.packbits(np.unpackbits(data, bitorder="little", count=count * width).reshape(count, width), axis=1, bitorder="little")
    out = np.zeros((count, 4), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<u4").ravel()


def encode_blob(ids: np.ndarray) -> bytes:
    """ids: unsigned 32-bit integers."""
    ids = np.asarray(ids, np.uint32)
    widths = best_widths(ids) if len(ids) else [1]
    out = [MAGIC, struct.pack("<IB", len(ids), len(widths)), bytes(widths)]
    rest = ids
    for k, w in enumerate(widths):
        out.append(struct.pack("<I", len(rest)))
        out.append(_pack(rest & np.uint32((1 << w) - 1), w))
        if k + 1 < len(widths):
            rest = (rest.astype(np.uint64) >> np.uint64(w)).astype(np.uint32)
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(_ONES[bitmap].astype(np.uint32), np.arange(0, len(bitmap), BLOCK // 8)) if len(bitmap) else np.zeros(0, np.uint32)
            out += [bitmap.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            rest = rest[more]
    return b"".join(out)


class Blob:
    """A blob read back: blob[i] is one id, blob.all() all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a blob of directly addressable codes")
        self.n, levels = struct.unpack_from("<IB", data, 4)
        self.widths = list(data[9 : 9 + levels])
        at, self.levels = 9 + levels, []
        for k, w in enumerate(self.widths):
            (count,) = struct.unpack_from("<I", data, at)
            size = (count * w + 7) // 8
            chunks = np.frombuffer(data, np.uint8, size, at + 4)
            at += 4 + size
            bitmap = directory = None
            if k + 1 < levels:
                bitmap = np.frombuffer(data, np.uint8, (count + 7) // 8, at)
                at += len(bitmap)
                directory = np.frombuffer(data, "<u4", (len(bitmap) + BLOCK // 8 - 1) // (BLOCK // 8), at)
                at += 4 * len(directory)
            self.levels.append((count, chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for w, (_, chunks, bitmap, directory) in zip(self.widths, self.levels, strict=True):
            first, last = i * w // 8, (i * w + w + 7) // 8
            value |= (int.from_bytes(chunks[first:last].tobytes(), "little") >> (i * w % 8) & (1 << w) - 1) << shift
            shift += w
            if bitmap is None or not bitmap[i // 8] >> (i % 8) & 1:
                break
            block = i // BLOCK
            before = _ONES[bitmap[block * BLOCK // 8 : i // 8]].sum(dtype=np.int64)
            i = int(directory[block]) + int(before) + bin(int(bitmap[i // 8]) & (1 << i % 8) - 1).count("1")
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at, shift = np.arange(self.n), 0
        for w, (count, chunks, bitmap, _) in zip(self.widths, self.levels, strict=True):
            out[at] |= _unpack(chunks, count, w) << np.uint32(shift)
            shift += w
            if bitmap is not None:
                at = at[np.unpackbits(bitmap, bitorder="little", count=count).astype(bool)]
        return out


class LibraryEncoder(Encoder):
    """Words encoded by the tokenizers library's model of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        read_settings(path)
        t = Tokenizer.from_file(path)
        super().__init__({x.content: i for i, x in t.get_added_tokens_decoder().items()})
        self.tokenize = t.model.tokenize
        self.shown = str.maketrans({chr(b): c for c, b in byte_characters().items()})

    def one_word(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        if word.isascii():  # only a leading space is shown as another character
            word = "\u0120" + word[1:] if word[0] == " " and word.isprintable() and " " not in word[1:] else word.translate(self.shown)
            return [x.id for x in self.tokenize(word)]
        return [x.id for x in self.tokenize(word.encode().decode("latin-1").translate(self.shown))]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = []
        for w in words:
            ids += self.one_word(w)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array([0, *ends], np.int64))


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_token_file(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, partitions: int | None = None) -> DataFrame:
    """Writes the ids of all texts in ascending order of id_col (ties by a hash of the text, then the text) and returns the file's table.

    Columns: part, segment (the order), n_docs, n_ids, docs (id_col as int64, a bitmap of nulls before), counts (ids per document as unsigned 32-bit),
    codes (the blob). Null text is empty; end_id is appended to each document. Rows of one table may repeat: each is a document.
    A tokenizer file with settings other than plain byte-level BPE is an error. One range shuffle of the texts, whose sample on the driver holds ids and hashes
    alone, so an id that many rows share is split; a task holds one segment and one batch of texts.
    """
    rows = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    by = [F.col("id").asc_nulls_first(), F.col("h").asc()]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *by).sortWithinPartitions(*by, F.col("text").asc_nulls_first()).drop("h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, size
            ids = np.concatenate([x for _, x in held])
            docs = np.array([x or 0 for x, _ in held], "<i8").tobytes()
            nulls = np.packbits([x is None for x, _ in held]).tobytes()
            counts = np.array([len(x) for _, x in held], "<u4").tobytes()
            out = pa.RecordBatch.from_pydict({"part": [part], "segment": [segment], "n_docs": [len(held)], "n_ids": [len(ids)], "docs": [nulls + docs], "counts": [counts], "codes": [encode_blob(ids)]}, schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())]))
            segment, size = segment + 1, 0
            held.clear()
            return out

        for b in small_batches(batches):
            docs = b.column("id").to_pylist()
            for row, rows, found, first in encoder.encode_texts(b.column("text")):
                for k in range(rows):
                    ids = np.concatenate([found[first[k] : first[k + 1]], tail])
                    if held and size + len(ids) > SEGMENT:
                        yield flush()
                    held.append((docs[row + k], ids))
                    size += len(ids)
        if held:
            yield flush()

    schema = "part int, segment int, n_docs long, n_ids long, docs binary, counts binary, codes binary"
    return write_table(ordered.mapInArrow(tidy(write), schema), "token-file")


def _documents(row: dict) -> tuple[list[int | None], np.ndarray, Blob]:
    """The documents' ids, how many ids each has, and the blob."""
    n = row["n_docs"]
    nulls = np.unpackbits(np.frombuffer(row["docs"], np.uint8, (n + 7) // 8), count=n)
    docs = np.frombuffer(row["docs"], "<i8", n, (n + 7) // 8).tolist()
    return [None if null else doc for doc, null in zip(docs, nulls, strict=True)], np.frombuffer(row["counts"], "<u4").astype(np.int64), Blob(row["codes"])


def segment_starts(file: DataFrame) -> DataFrame:
    """part, segment and start: the ids in all segments before. The running sum over all parts has one row a part."""
    sizes = file.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    return sizes.select("part", "segment", inside.alias("inside")).join(parts, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("start"))


def tokens_at(file: DataFrame, positions: list[int]) -> DataFrame:
    """(position, id) of the ids at some places of the whole file, each read alone: only blobs that hold one are opened, and none is decoded. Places beyond the file have no row."""
    wanted = file.sparkSession.createDataFrame([(p,) for p in positions], "position long")
    spans = segment_starts(file).join(file.select("part", "segment", "n_ids"), ["part", "segment"])
    inside = spans.join(F.broadcast(wanted), (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_ids")))
    rows = file.select("part", "segment", "codes").join(inside.groupBy("part", "segment").agg(F.collect_list("position").alias("positions"), F.first("start").alias("start")), ["part", "segment"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            for row in b.to_pylist():
                blob = Blob(row["codes"])
                yield pa.RecordBatch.from_pydict({"position": row["positions"], "id": [blob[p - row["start"]] for p in row["positions"]]}, schema=pa.schema([("position", pa.int64()), ("id", pa.int64())]))

    return rows.mapInArrow(tidy(read), "position long, id long")


def read_token_file(file: DataFrame, *, digests: bool = False, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens, and ids (array<long>); or, with digests, ids_crc32 and middle_id.

    ids_crc32: unsigned, of the ids as little-endian unsigned 32-bit integers. middle_id: the id at n_tokens // 2, read by random access (null without ids).
    The starts of the segments (a row for about SEGMENT ids) are broadcast if their table is under broadcast_bytes.
    """
    last = {"ids_crc32": pa.int64(), "middle_id": pa.int64()} if digests else {"ids": pa.list_(pa.int64())}
    names = ["part", "segment", "doc_id", "inside", "n_tokens", *last]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            for row in b.to_pylist():
                docs, counts, blob = _documents(row)
                ids, ends = np.ascontiguousarray(blob.all(), "<u4"), np.cumsum(counts)
                starts = ends - counts
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                if digests:
                    values = [[zlib.crc32(ids[a:e].tobytes()) for a, e in spans], [blob[(a + e) // 2] if e > a else None for a, e in spans]]
                else:
                    values = [[ids[a:e].astype(np.int64) for a, e in spans]]
                same = [pa.array([row[k]] * len(docs), pa.int32()) for k in ("part", "segment")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(docs, pa.int64()), pa.array(starts), pa.array(counts), *map(pa.array, values, last.values())], names=names)

    kinds = "ids_crc32 long, middle_id long" if digests else "ids array<long>"
    docs = file.mapInArrow(tidy(read), f"part int, segment int, doc_id long, inside long, n_tokens long, {kinds}")
    starts = write_table(segment_starts(file), "segment-starts")
    starts = F.broadcast(starts) if table_bytes(starts) <= broadcast_bytes else starts
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", *last)
