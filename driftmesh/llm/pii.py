"""Personal data: four base patterns, and identifiers found by bootstrapped contextual extraction.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. They are also the seeds of a bootstrap over
a graph of contexts, instances and shapes. A candidate is a stretch with digits, of one piece or of several a blank apart,
brackets and hyphens included. Its contexts are words: what stands before it in its own word, the word before, the two
words before, the next word. Its shape has digits as 9 and letters as a. In every round a context is confident if known
instances, enough different ones, make up most of its occurrences in the whole corpus (so a word that stands everywhere
never is), and an instance in a confident context becomes known if its shape mostly stands in such contexts; contexts are
apart from shapes, so those that seeds made confident admit other shapes. At the end candidates in confident contexts, of
good shapes, that no base pattern covers are spans of kind `found`.

Null and empty texts have no spans, an empty table gives no rows. Ids pass through, repeated rows are searched alike,
other columns, whatever their names, are not looked at. Texts are searched whole; candidates, contexts and shapes of any
length take part, long ones by their hash. Base matches are leftmost, not overlapping per kind, and dropped if they fail
their check. Instances are kept as 64-bit hashes. All counts are over all rows; contexts, instances and shapes are folded
before they are joined, and looked up by joins that are broadcast when small by count and salted otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.common import look_up, materialize, slices, small_side

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "found")

#: The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: What parts pieces in the search for candidates, besides white space; a candidate may span single blanks.
SEPARATORS = " \t\n\x0b\x0c\r|,;:<>[]{}\"'="
LEAST_CHARS = 6
LEAST_DIGITS = 3
#: Longer contexts and shapes are told apart by their hash.
LABEL_CHARS = 64

# possessive and anchored where the matches are the same, so that long runs of digits take linear time
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_card, _phone = re.compile(CARD), re.compile(PHONE)
_domain = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digit = re.compile("[0-9]")
_not_digits = re.compile("[^0-9]")
_piece = re.compile("[^" + re.escape(SEPARATORS) + "]+")
_not_white = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    doubled = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kind is the place in KINDS."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            last = m.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    if "." in text:
        out += [(1, *m.span()) for m in _ip.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split(".")))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _not_digits.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= len(_not_digits.sub("", m[0])) <= 15]
    return out


_SHAPE = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a")]


def _hash(text: str) -> int:
    import xxhash

    n = xxhash.xxh64_intdigest(text.encode())
    return n - (1 << 64) if n >> 63 else n


def label(text: str) -> str:
    return text if len(text) <= LABEL_CHARS else f"\n{_hash(text)}"  # no word holds a line break


def shape(token: str) -> str:
    for pattern, mark in _SHAPE:
        token = pattern.sub(mark, token)
    return label(token)


def candidates(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches between begin and end that may be identifiers: pieces with digits, and such pieces a blank apart."""
    at = begin
    while m := _digit.search(text, at, end):
        start = m.start()
        while start > at and text[start - 1] not in SEPARATORS:
            start -= 1
        stop = _piece.match(text, m.start(), end).end()
        while stop < end and text[stop] == " " and (more := _piece.match(text, stop + 1, end)) and _digit.search(more[0]):
            stop = more.end()
        at = stop
        while start < stop and not (text[start].isalnum() or text[start] in "+(#"):
            start += 1
        while stop > start and not (text[stop - 1].isalnum() or (text[stop - 1] == ")" and "(" in text[start:stop])):
            stop -= 1
        if stop - start >= LEAST_CHARS and len(_not_digits.sub("", text[start:stop])) >= LEAST_DIGITS:
            yield start, stop


def lower(text: str) -> str:
    """A-Z lowered; the same characters as in the counts of words by Spark."""
    return text.encode().lower().decode()


class Words:
    """The words of a text, parted by ASCII white space, and their labels in lower case."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _not_white.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.known: dict[int, str] = {}

    def __getitem__(self, k: int) -> str:
        if k not in self.known:
            self.known[k] = lower(self.text[self.starts[k] : self.ends[k]])
        return self.known[k]

    def contexts(self, start: int, end: int, last: int) -> list[str]:
        """What stands before a stretch in its own word, since `last` (p), else the word before (1) and the two words
        before (2); and the next word (r)."""
        k, out = bisect_right(self.starts, start) - 1, []
        if self.starts[k] < start:
            out.append("p " + label(lower(self.text[max(last, self.starts[k]) : start])))
        elif k > 0:
            out.append("1 " + label(self[k - 1]))
            if k > 1:
                out.append("2 " + label(self[k - 2] + " " + self[k - 1]))
        k = bisect_right(self.starts, end - 1)
        if k < len(self.starts):
            out.append("r " + label(self[k]))
        return out


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(contexts, instance, shape, seed, start, end) of the base spans and of the candidates between them."""
    covered = sorted({(s, e) for _, s, e in spans})
    found, at = [(s, e, True) for s, e in covered], 0
    for s, e in [*covered, (len(text), len(text))]:
        found += [(*c, False) for c in candidates(text, at, s)] if s > at else []
        at = max(at, e)
    if not found:
        return []
    words, last, out = Words(text), 0, []
    for s, e, seed in sorted(found):
        out.append((words.contexts(s, e, min(last, s)), _hash(text[s:e]), shape(text[s:e]), seed, s, e))
        last = max(last, e)
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(pa.struct([("contexts", pa.list_(pa.string())), ("instance", pa.int64()), ("shape", pa.string()), ("seed", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))
_SCANNED = "doc_id long, row long, base array<struct<kind:int,start:int,end:int>>, found array<struct<contexts:array<string>,instance:long,shape:string,seed:boolean,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its base spans and occurrences; `row` tells rows apart, whatever their ids."""
    row = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        spans, found = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            found.append([dict(zip(("contexts", "instance", "shape", "seed", "start", "end"), o)) for o in occurrences(text, base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(row, row + batch.num_rows), pa.int64()), pa.array(spans, _SPANS), pa.array(found, _FOUND)], names=["doc_id", "row", "base", "found"])
        row += batch.num_rows


def context_counts(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, total): how often each of these contexts of words (1, 2, r) stands in any text, whatever follows."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    asked = contexts.withColumn("gram", F.when(F.col("context").startswith("r "), F.concat(F.lit("1 "), F.substring("context", 3, LABEL_CHARS + 30))).otherwise(F.col("context")))
    asked = materialize(asked, "pii-asked")
    hashed = lambda w: F.when(F.length(w) <= LABEL_CHARS, w).otherwise(F.lit(None))  # noqa: E731  long ones are not counted here
    held = rows.select(words.alias("w"))
    singles = F.transform("w", lambda w: F.concat(F.lit("1 "), hashed(w)))
    pairs = F.transform("w", lambda w, i: F.concat(F.lit("2 "), hashed(F.concat(F.get("w", i - 1), F.lit(" "), w))))
    grams = held.select(F.explode(F.concat(singles, pairs)).alias("gram")).filter("gram is not null")
    met = grams.join(small_side(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("total"))
    return asked.join(met, "gram").select("context", "total")


def confident(scanned: DataFrame, rows: DataFrame, rounds: int = 2, pattern_confidence: float = 0.6, shape_share: float = 0.3, least_instances: int = 5) -> tuple[DataFrame, DataFrame]:
    """(context), (shape): the contexts and shapes that extract, after the rounds over the graph.

    A context's confidence is the share of known instances among all its occurrences in the corpus; it needs
    least_instances different ones. An instance becomes known in a confident context if of all occurrences of its shape a
    share of shape_share stands in confident contexts.
    """
    each = scanned.select(F.explode("found").alias("o")).select("o.instance", "o.shape", "o.seed", "o.contexts")
    instances = materialize(each.groupBy("instance").agg(F.max("shape").alias("shape"), F.count(F.lit(1)).alias("times"), F.max("seed").alias("seed")), "pii-instances")
    edges = materialize(each.select(F.explode("contexts").alias("context"), "instance").groupBy("context", "instance").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    able = edges.groupBy("context").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("seen")).filter(F.col("different") >= least_instances)
    able = materialize(able, "pii-able")
    in_words = context_counts(rows, able.filter(~F.col("context").startswith("p ") & (F.substring("context", 3, 1) != "\n")).select("context"))
    totals = materialize(able.join(in_words, "context", "left").select("context", F.greatest("seen", F.coalesce("total", F.lit(0))).alias("total")), "pii-totals")
    graph = materialize(look_up(edges, totals, "context"), "pii-graph")
    known = instances.filter("seed").select("instance")

    def scored(known: DataFrame) -> DataFrame:
        met = look_up(graph, materialize(known, "pii-known"), "instance")
        by_context = met.groupBy("context").agg((F.sum("n") / (F.max("total") + 1)).alias("confidence"), F.count(F.lit(1)).alias("different"))
        return materialize(by_context.filter((F.col("confidence") >= pattern_confidence) & (F.col("different") >= least_instances)).select("context"), "pii-contexts")

    def shapes(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
        hits = materialize(look_up(graph, contexts, "context").groupBy("instance").agg(F.sum("n").alias("hits")), "pii-hits")
        told = materialize(instances.join(hits, "instance", "left").withColumn("hits", F.least("times", F.coalesce("hits", F.lit(0)))), "pii-told")
        good = told.groupBy("shape").agg((F.sum("hits") / F.sum("times")).alias("share")).filter(F.col("share") >= shape_share).select("shape")
        return told, materialize(good, "pii-shapes")

    for _ in range(rounds):
        contexts = scored(known)
        told, good = shapes(contexts)
        known = look_up(told.filter("hits > 0"), good, "shape").select("instance").unionByName(instances.filter("seed").select("instance")).distinct()
    contexts = scored(known)
    return contexts, shapes(contexts)[1]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap) -> DataFrame:
    """(doc_id, spans) of every row; spans by kind, then start, in code points, end exclusive."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, _SCANNED), "pii")
    contexts, shapes = confident(scanned, rows.select("text"), **bootstrap)
    # rows without a candidate need no join; the others meet contexts and shapes by their candidates
    open_to = F.exists("found", lambda o: ~o["seed"])
    placed, lone = scanned.filter(open_to), scanned.filter(~open_to).select("doc_id", F.col("base").alias("spans"))
    asked = placed.select("row", F.explode(F.filter("found", lambda o: ~o["seed"])).alias("o")).select("row", "o.start", "o.end", "o.shape", F.explode("o.contexts").alias("context"))
    met = look_up(look_up(asked, contexts, "context"), shapes, "shape").select("row", "start", "end").distinct()
    added = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("added"))
    more = placed.join(added, "row", "left").select("doc_id", F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))).alias("spans"))
    return lone.unionByName(more)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
