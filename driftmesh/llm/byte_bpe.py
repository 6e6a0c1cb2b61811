"""Byte-level BPE by the tokenizers library: encoding, offsets and decoding over Arrow batches.

The rank file gives byte strings; each byte stands for one printable character (the table of byte-level BPE). The rank
rule joins, as long as it can, the adjacent pair whose joint token has the least rank, the leftmost on a tie. Each token
thus comes from one pair only: while a token forms, nothing has crossed its ends, so what happens inside is what the rule
does to its bytes alone, and the last pair there is the only one that ever yields it. Those pairs, in the order of ranks,
are the merges of a BPE model, which then obeys the rank rule; a piece that is itself a token is taken as it is.

Texts are cut by the pattern; the library encodes every new piece of a slice in one batch, with offsets, and a worker
remembers pieces in a bounded cache. Decoding maps ids to characters, characters through the reversed table to bytes, and
joins the bytes of all ids before reading characters, so characters split over ids come back whole.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Texts are encoded whole: a very long piece
costs n log n. Null and repeated ids are rows like others, an empty table gives no rows, and columns other than the two
named are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import slices

#: Pieces that a worker remembers before it starts anew, and the longest it remembers; together they bound memory.
CACHE_PIECES = 300_000
CACHE_CHARS = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next of U+0100 onwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that the rank rule joins last when it forms the token from bytes; None if it never does."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        joint = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(joint)
        if rank == len(ranks):
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def latin_splitter(pattern: str):
    """findall of the pattern by the standard library, which is quicker, for texts of Latin-1 only: its classes of
    letters, numbers and blanks are written out. None if the pattern has other classes."""
    chars = [chr(i) for i in range(256)]
    listed = {p: "".join(map(re.escape, (c for c in chars if regex.match(p, c)))) for p in (r"\p{L}", r"\p{N}", r"\s")}
    out, at, inside = [], 0, False
    while at < len(pattern):
        if pattern[at] != "\\":
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at])
            at += 1
            continue
        found = next((p for p in (*listed, r"\S") if pattern.startswith(p, at)), None)
        if found is None or (inside and found == r"\S"):
            return None
        out.append(f"[^{listed[chr(92) + 's']}]" if found == r"\S" else listed[found] if inside else f"[{listed[found]}]")
        at += len(found)
    return re.compile("".join(out)).findall


class ByteBPE:
    def __init__(self, rank_file: str, pattern: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(rank_file)
        chars = byte_characters()
        shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        pairs = [last_pair(t, ranks) for t in sorted(ranks, key=ranks.__getitem__)]
        merges = [(shown[p[0]], shown[p[1]]) for p in pairs if p]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        byte_of = {c: b for b, c in enumerate(chars)}
        self.table = {i: bytes(map(byte_of.__getitem__, token)) for token, i in self.tokenizer.get_vocab().items()}
        self.split = regex.compile(pattern).findall
        self.split_latin = latin_splitter(pattern)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.cache_pieces = cache_pieces

    def pieces(self, text: str) -> list[str]:
        if self.split_latin:
            try:
                text.isascii() or text.encode("latin-1")
                return self.split_latin(text)
            except UnicodeEncodeError:
                pass
        return self.split(text)

    def _encoded(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """For each piece its ids, and start and end of each id, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > self.cache_pieces:
            self.cache.clear()
        try:
            return [self.cache[p] for p in pieces]
        except KeyError:
            new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        got = {}
        for piece, done in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            got[piece] = array("I", done.ids).tobytes(), np.array(done.offsets, "<u4").tobytes()
        self.cache.update((p, e) for p, e in got.items() if len(p) <= CACHE_CHARS)
        return [self.cache.get(p) or got[p] for p in pieces]

    def encode_bytes(self, text: str) -> tuple[bytes, bytes]:
        """Ids, and of each id start and end in characters of the text, as little-endian unsigned 32-bit integers; ids
        that share a character both cover it."""
        pieces = self.pieces(text)
        found = self._encoded(pieces)
        if not found:
            return b"", b""
        ids, spans = zip(*found)
        firsts = np.fromiter(accumulate(map(len, pieces[:-1]), initial=0), np.uint32, len(pieces))
        places = np.frombuffer(b"".join(spans), "<u4") + np.repeat(firsts, np.fromiter(map(len, spans), np.int64, len(spans)) >> 2)
        return b"".join(ids), places.tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, spans): spans has a row of start and end for each id."""
        ids, spans = self.encode_bytes(text)
        return np.frombuffer(ids, "<u4"), np.frombuffer(spans, "<u4").reshape(-1, 2)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids) -> str:
        """Bytes that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(4)
def byte_bpe(rank_file: str, pattern: str) -> ByteBPE:
    return ByteBPE(rank_file, pattern)


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, ids, and starts and ends in characters if asked for), one row per row of docs."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_file, pattern)
        for batch in slices(batches):
            out = [[], [], []]
            for text in batch.column(1).to_pylist():
                ids, spans = bpe.encode(text)
                for cell, value in zip(out, (ids, spans[:, 0], spans[:, 1])):
                    cell.append(value.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, kind) for c, (_, kind) in zip(out, fields[1:])]], schema=pa.schema(fields))

    return _text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text, bytes) from ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_file, pattern)
        for batch in slices(batches):
            raw = [bpe.decode_bytes(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string()), pa.array(raw, pa.binary())], names=["doc_id", "text", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string, bytes binary")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string"


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256): encodes and decodes each text within one pass over
    the rows. The last is of start and end of each id as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_file, pattern)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids, spans = bpe.encode_bytes(text)
                decoded = bpe.decode_bytes(array("I", ids))
                rows.append((len(ids) // 4, *[hashlib.sha256(b).hexdigest() for b in (ids, decoded, spans)]))
            n, *digests = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *[pa.array(d, pa.string()) for d in digests]], names=[c.split()[0] for c in _DIGESTS.split(", ")])

    return _text_rows(docs, id_col, text_col).mapInArrow(run, _DIGESTS)
