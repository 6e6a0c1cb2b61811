"""Packing documents into training sequences by order-preserving dynamic programming.

The token stream of a run of documents is cut into windows of at most `window` tokens. A window costs its padding (its
length up to `window`; none where its length is a power of two) and each cut costs a truncation penalty: none between
documents, `sentence_cut` after a sentence, `word_cut` elsewhere. Padding falls by one for every token of length, so the
best predecessor of a cut is the least of f(i) + position(i) over the last `window` tokens: a monotone queue gives it in
constant time; besides, cuts a power of two before are tried. Every end of a document or a sentence is a candidate, and
within sentences of over LONG_SENTENCE tokens every WORD_STEP tokens. Documents keep their order, every token lies in
exactly one piece, and a window is one sequence.

Runs of documents stay within a task, `run_tokens` at most besides the last document, so memory is bounded by that and
the longest document. In the last window of a run every token may be a cut, and powers of two use up what is left.

Null texts count as empty: such a document is its end id alone. Null and repeated ids pass through; rows are packed
singly. An empty table gives no rows. Other columns of the input are not looked at, whatever their names. A very long
text is one document of its run; its own tokens bound what is held besides.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.byte_bpe import byte_characters
from driftmesh.llm.common import give_back, giving_back, slices

CACHE_WORDS = 500_000
#: Tokens after which a run ends with the document at hand: bounds a worker's memory.
RUN_TOKENS = 1_048_576
#: Sentences of more tokens may also be cut within, at every so many tokens.
LONG_SENTENCE, WORD_STEP = 192, 48

#: Separators that str.split() knows and the tokenizer does not.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"


STOPS = frozenset(".,!?")

#: How the tokenizer parts a lower-case word; fixed value.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class Remembered:
    """A mapping filled on demand that keeps what was asked for lately: two generations of at most `most` entries."""

    def __init__(self, fill, most: int):
        self.fill, self.most = fill, most
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, keys: list) -> list:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young = self.young
        found = list(map(young.get, keys))
        gaps = [i for i, value in enumerate(found) if value is None]
        if gaps:
            wanted = {keys[i] for i in gaps}
            moved = wanted & self.old.keys()
            if moved:
                young.update({key: self.old[key] for key in moved})
                wanted -= moved
            new = list(wanted)
            young.update(zip(new, self.fill(new)))
            for i in gaps:
                found[i] = young[keys[i]]
        return found


class WordTokenizer:
    """A tokenizer of the tokenizers library that lower-cases and drops white space, word by word.

    Words are parted as the tokenizer parts them and its model encodes the parts, each once as long as it is remembered;
    that gives the same ids as encoding the whole text. Words outside Latin-1, where normalisation may change letters,
    and words that may hold special tokens go through the whole tokenizer.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        self.model = Tokenizer(self.whole.model)
        self.chars = byte_characters()
        self.part = regex.compile(PARTS).findall
        self.find = re.compile(r"[^\x20\x09-\x0D]+").findall
        self.apart = re.compile(r"[.,](?<=[a-z\xdf-\xf6\xf8-\xff][.,])(?=\s)").sub
        self.ids_of = Remembered(self._fill, cache_words)  # of words, as little-endian unsigned 32-bit integers
        self._ids_of_part = Remembered(self._parts, cache_words)

    def words(self, text: str) -> list[str]:
        """Strings whose ids, joined, are the text's: words, with stops and commas after a letter set apart."""
        if "<|" in text or any(c in text for c in ODD_BLANKS):
            return self.find(text)  # special tokens are matched before letters are lowered
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return self.apart(r" \g<0>", text.lower()).split()

    def _fill(self, words: list[str]) -> list[bytes]:
        plain = [w.isalpha() and (w.isascii() or max(w) <= "\xff") for w in words]
        simple = iter(self._parts([w.lower() for w, ok in zip(words, plain) if ok]))
        others = iter(self._words([w for w, ok in zip(words, plain) if not ok]))
        return [next(simple) if ok else next(others) for ok in plain]

    def _parts(self, parts: list[str]) -> list[bytes]:
        # letters of ASCII stand for themselves in the table of bytes
        shown = [p if p.isascii() and p.isalpha() else "".join(map(self.chars.__getitem__, p.encode())) for p in parts]
        return [array("I", done.ids).tobytes() for done in self.model.encode_batch_fast(shown, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        parts, counts, odd = [], [], []
        for word in words:
            if word.isalpha() and (word.isascii() or max(word) <= "\xff"):  # most words: one part of letters
                parts.append(word.lower())
                counts.append(1)
            elif word[-1:] in STOPS and word.isascii() and word[:-1].isalpha():  # letters and a stop
                parts += (word[:-1].lower(), word[-1])
                counts.append(2)
            elif (word.isascii() or max(word) <= "\xff") and "<|" not in word:
                found = self.part(word.lower())
                parts += found
                counts.append(len(found))
            else:
                odd.append(word)
                counts.append(-1)
        ids = self._ids_of_part(parts)
        whole = iter(self.whole.encode_batch_fast(odd, add_special_tokens=False)) if odd else None
        out, at = [], 0
        for n in counts:
            if n == 1:
                out.append(ids[at])
                at += 1
            elif n < 0:
                out.append(array("I", next(whole).ids).tobytes())
            else:
                out.append(b"".join(ids[at : at + n]))
                at += n
        return out


@lru_cache(2)
def word_tokenizer(file: str) -> WordTokenizer:
    return WordTokenizer(file)


def best_cuts(positions: list[int], penalties: list[float], window: int) -> list[int]:
    """Indices of the chosen cuts: the first and last always, no two further than window apart.

    positions ascend strictly, from the start of the stream to its end; penalties[i] is paid if i is cut.
    """
    n, first = len(positions), positions[0]
    places = np.array(positions, np.int64) - first
    index_at = np.full(int(places[-1]) + 1, -1)
    index_at[places] = np.arange(n)
    # (j, k): cuts a power of two apart, so that the window between them needs no padding
    met = []
    for power in (1 << e for e in range(window.bit_length()) if 1 << e < window):
        later = np.flatnonzero(places >= power)
        k = index_at[places[later] - power]
        met.append(np.stack([later[k >= 0], k[k >= 0]]))
    js, ks = np.concatenate(met, axis=1) if met else np.zeros((2, 0), np.int64)
    order = np.argsort(js, kind="stable")
    bounds, ks = np.searchsorted(js[order], np.arange(n + 1)).tolist(), ks[order].tolist()
    cost, back = [0.0] * n, [0] * n
    queue = deque([(first + 0.0, 0)])  # (cost + position, index), both ascending
    for j in range(1, n):
        here = positions[j]
        while positions[queue[0][1]] < here - window:
            queue.popleft()
        low, i = queue[0]
        low += window - here
        lo, hi = bounds[j], bounds[j + 1]
        if lo != hi:
            for k in ks[lo:hi]:
                if cost[k] < low:
                    low, i = cost[k], k
        cost[j] = low = low + penalties[j]
        back[j] = i
        low += here
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def cut_positions(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, sentence_cut: float, word_cut: float) -> list[int]:
    """Token positions of the windows' borders for one run of documents."""
    total = int(doc_ends[-1])
    stops = np.unique(np.concatenate([[0], sentence_ends, doc_ends]))
    step = min(WORD_STEP, window)
    wide = np.flatnonzero(np.diff(stops) > min(LONG_SENTENCE, window))
    inner = [np.arange(stops[i] + step, stops[i + 1], step) for i in wide]
    last = np.arange(max(0, total - window), total)
    positions = np.unique(np.concatenate([stops, last, *inner]))
    penalties = np.full(len(positions), word_cut)
    penalties[np.isin(positions, sentence_ends)] = sentence_cut
    penalties[np.isin(positions, doc_ends)] = 0.0
    places = positions.tolist()
    return [places[i] for i in best_cuts(places, penalties.tolist(), window)]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer_file: str, end_id: int = 2, window: int = 4096, sentence_cut: float = 12.0, word_cut: float = 24.0, run_tokens: int = RUN_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def pieces(ids: list, streams: list[bytes], sentences: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        sizes = np.array([len(s) // 4 for s in streams])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        marks = np.concatenate([m + s for m, s in zip(sentences, starts)])
        cuts = np.array(cut_positions(ends, marks, window, sentence_cut, word_cut))
        edges = np.union1d(cuts, np.concatenate([[0], ends]))
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, lo, side="right")
        seq = np.searchsorted(cuts, lo, side="right") - 1
        begin = lo - starts[doc]
        blobs = [streams[d][4 * b : 4 * (b + n)] for d, b, n in zip(doc.tolist(), begin.tolist(), (hi - lo).tolist())]
        columns = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), begin, hi - lo, pa.array(blobs, pa.binary()), sizes[doc], seq + first, lo - cuts[seq]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=PIECES), first + len(cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_file)
        end = array("I", [end_id]).tobytes()
        first, held = TaskContext.get().partitionId() << 40, 0
        ids, streams, sentences = [], [], []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokenizer.words(text)
                parts = tokenizer.ids_of(words)
                stops = [i for i, w in enumerate(words, 1) if w[-1] in ".!?"]
                ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
                ids.append(doc_id)
                streams.append(b"".join(parts) + end)
                sentences.append(ends[np.array(stops, np.int64) - 1])
                held += len(streams[-1]) // 4
                if held >= run_tokens:
                    out, first = pieces(ids, streams, sentences, first)
                    ids, streams, sentences, held = [], [], [], 0
                    yield out
                    del out
                    give_back()
        if ids:
            yield pieces(ids, streams, sentences, first)[0]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(giving_back(run), PIECES_DDL)
