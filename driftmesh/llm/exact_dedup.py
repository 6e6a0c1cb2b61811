"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Partitions cut their rows into blocks, sort each block's 64-bit fingerprints by owner (the leading bits) and send
the owners Golomb-Rice codes of the differences. Owners answer with a bitmap per message: a set bit says that the
fingerprint occurs elsewhere too. The bitmaps, a bit a row, go back to the blocks (broadcast if they are few bytes, by
measure), so ids and hashes of the rows are not shuffled. Only the suspects' texts are then shuffled and grouped by their
bytes; copies fold before the shuffle.

Null texts count as empty; empty texts are equal to each other. Rows with a null doc_id take part; a null is never
chosen as keep_id while the group has another id. Rows that repeat a doc_id count singly in group_size and share
`kept`. An empty table gives no rows. Other columns of the input, whatever their names, are not looked at, and stay in
drop_copies(). Texts are hashed and compared whole; a very long one is one row of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import discard, fresh, giving_back, look_up, materialize, partition_slots, small_side

#: Rows of a block: bounds what a partition holds at a time; blocks grow with the owners, so that messages stay worth
#: sending, up to the second figure.
BLOCK_ROWS, MOST_BLOCK_ROWS = 50_000, 400_000
#: Rows whose fingerprints one owner sees.
OWNER_ROWS = 2_000_000
#: Bytes of bitmaps that may be broadcast.
BITMAP_BYTES = 64 << 20

WHITE = r"[\x20\x09-\x0D]"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted uint64 values as Rice codes of their differences, the first from zero: all unary quotients (ones, then
    a zero), then all k-bit remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    bits = np.ones(int(ends[-1]) + 1 + k * len(values), np.uint8)
    bits[ends] = 0
    if k:
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        bits[int(ends[-1]) + 1 :] = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(bits).tobytes()


def golomb_decode(payload: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        start = int(ends[-1]) + 1
        rest = bits[start : start + n * k].reshape(n, k).astype(np.uint64)
        gaps |= (rest << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


BLOCKS = pa.schema([
    ("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("payload", pa.binary()), ("repeated", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("hashes", pa.list_(pa.binary())), ("slots", pa.list_(pa.int32())),
])
BLOCKS_DDL = "block long, owner int, n int, k int, payload binary, repeated binary, doc_ids array<long>, lengths array<long>, hashes array<binary>, slots array<int>"


def _blocks(owner_bits: int, block_rows: int):
    def pack(block: int, rows: pa.Table) -> pa.RecordBatch:
        hashes = rows["hash"].to_numpy(zero_copy_only=False)
        prints = np.frombuffer(b"".join(h[:8] for h in hashes), ">u8").astype(np.uint64)
        unique, slots, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner_of = (unique >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(unique), np.int64)
        owners, starts = np.unique(owner_of, return_index=True)
        order = np.argsort(slots, kind="stable")
        row_starts = np.searchsorted(slots[order], starts)
        out = {name: [] for name in BLOCKS.names}
        mask = np.uint64((1 << (64 - owner_bits)) - 1)
        for i, owner in enumerate(owners):
            lo, hi = starts[i], starts[i + 1] if i + 1 < len(owners) else len(unique)
            mine = order[row_starts[i] : row_starts[i + 1] if i + 1 < len(owners) else len(order)]
            values, n = unique[lo:hi] & mask, int(hi - lo)
            k = max(0, int(np.log2(max(1.0, 0.69 * float(mask) / n))))
            cells = (block, int(owner), n, k, golomb_encode(values, k), np.packbits(counts[lo:hi] > 1).tobytes())
            for name, value in zip(BLOCKS.names, (*cells, rows["doc_id"].take(mine).combine_chunks(), rows["n_chars"].take(mine).combine_chunks(), [hashes[j] for j in mine], slots[mine] - lo)):
                out[name].append(value)
        return pa.RecordBatch.from_pydict({name: pa.array([v.tolist() if hasattr(v, "tolist") else v for v in out[name]], BLOCKS.field(name).type) for name in BLOCKS.names}, schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                piece = batch.slice(at, block_rows)
                if size + piece.num_rows > block_rows and size:
                    yield pack(block, pa.Table.from_batches(held))
                    block, held, size = block + 1, [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield pack(block, pa.Table.from_batches(held))

    return run


def _answer(messages: pa.Table) -> pa.Table:
    """An owner's answer: for each message a bitmap of the fingerprints that occur twice or more."""
    sizes = messages["n"].to_pylist()
    values = [golomb_decode(p, n, k) for p, n, k in zip(messages["payload"].to_pylist(), sizes, messages["k"].to_pylist())]
    flags = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8))[:n] for r, n in zip(messages["repeated"].to_pylist(), sizes)]).astype(bool)
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    same = np.diff(every[order]) == 0
    again = np.zeros(len(every), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= flags
    ends = np.cumsum(sizes)
    maps = [np.packbits(again[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
    return pa.table({"block": messages["block"], "owner": messages["owner"], "bitmap": pa.array(maps, pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            flags = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8))[row["slots"]].astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(row["hashes"], pa.binary()), pa.array(flags)],
                names=["doc_id", "n_chars", "hash", "suspect"],
            )


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_bits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(doc_id, n_chars, hash, suspect) of every row, after the exchange. owner_bits: owners are 2 to this power; by
    default as many as shuffle partitions, and more where an owner would see over OWNER_ROWS rows."""
    if owner_bits is None:
        owner_bits = max(2, (max(partition_slots(docs), docs.count() // OWNER_ROWS) - 1).bit_length())
    if block_rows is None:
        block_rows = min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, 32 << owner_bits))
    light = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("hash"),
    )
    blocks = materialize(light.mapInArrow(giving_back(_blocks(owner_bits, block_rows)), BLOCKS_DDL), "blocks")
    messages = blocks.select("block", "owner", "n", "k", "payload", "repeated")
    answers = materialize(messages.groupBy("owner").applyInArrow(_answer, "block long, owner int, bitmap binary"), "answers")
    size = answers.agg(F.coalesce(F.sum(F.length("bitmap") + 64), F.lit(0))).first()[0]
    sent = F.broadcast(answers) if size <= BITMAP_BYTES else answers
    returned = blocks.select("block", "owner", "doc_ids", "lengths", "hashes", "slots").join(sent, ["block", "owner"])
    rows = materialize(returned.mapInArrow(giving_back(_rows), "doc_id long, n_chars long, hash binary, suspect boolean"), "prints")
    discard(blocks)
    discard(answers)
    return rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_bits: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Texts are equal when they are after deleting white space; the longest original, then the least doc_id, stays.
    """
    rows = fingerprint_rows(docs, id_col, text_col, owner_bits, block_rows)
    suspects = rows.filter("suspect")
    asked = small_side(suspects.select(F.col("doc_id").alias("suspect_id")).distinct())
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(asked, F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
    bodies = found.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised("text").alias("body"))
    # grouped by the bytes themselves: copies fold on the map side, so a text that half the corpus repeats stays small
    by_bytes = bodies.groupBy("body", "n_chars").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).select(
        F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("hash"), F.xxhash64("body").alias("other"), "n_chars", "least", "n"
    )
    groups = by_bytes.groupBy("hash").agg(
        F.max(F.struct("n_chars", F.col("least").isNotNull().alias("known"), (-F.col("least")).alias("neg"))).alias("best"),
        F.sum("n").alias("group_size"), (F.min("other") == F.max("other")).alias("same"),
    ).select(
        "hash", F.col("best.n_chars").alias("best_chars"), (-F.col("best.neg")).alias("keep_id"),
        F.when(F.col("same"), F.col("group_size")).otherwise(F.raise_error(F.lit("different texts under one sha256")).cast("long")).alias("group_size"),
    )
    matched = look_up(suspects, materialize(groups, "groups"), "hash").select(
        "doc_id", "keep_id", "group_size", ((F.col("n_chars") == F.col("best_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256")
    )
    alone = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"))
    return alone.unionByName(matched)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, all columns kept. Rows that repeat a doc_id with an equal text leave one."""
    decided = materialize(exact_dedup(docs, id_col, text_col, **options).filter("group_size > 1").select("doc_id", "kept", "text_sha256"), "decided")
    mine, key, sha = (fresh(c, docs) for c in ("own_sha", "copy_id", "copy_sha"))
    keys = materialize(decided.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("times")), "keys")
    marked = docs.withColumn(mine, F.sha2(normalised(text_col).cast("binary"), 256))

    def among(found: DataFrame, how: str) -> DataFrame:
        return marked.join(small_side(found.select(key, sha)), F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(sha)), how)

    out = among(keys.filter("not stays or times > 1"), "left_anti")
    repeated = keys.filter("stays and times > 1")
    if not repeated.isEmpty():
        out = out.unionByName(among(repeated, "left_semi").dropDuplicates([id_col, mine]))
    return out.select(*docs.columns)
