"""Toxicity, language-model scores, WARC and the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from driftmesh.llm import lm_scoring, toxicity, warc
from driftmesh.llm.common import crc_of_id

from .conftest import ODD

WORD = P.path("word_bpe_49k.json")
COMMON = "the of and river house morning light garden stone bridge walked quietly evening market children winter".split()


def prose(rng, n=60):
    return " ".join(rng.choice(COMMON) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = prose(rng).split()
        if bad:
            words[rng.randrange(50)] = rng.choice(["grumpface", "grumpfaced", "mudbrain"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + k, t) for k, t in enumerate(ODD)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[1000].score == got[1001].score and got[1000].predicted == 0


def test_toxicity_without_labels_and_rows(spark, docs_of, labelled):
    _, labels = labelled
    assert toxicity.score_toxicity(docs_of([]), labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs_of(["a", None]), labels.limit(0)).collect()} == {0}
    odd = spark.createDataFrame([(None, 1, 1), (0, 1, None), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs_of(["a", None, "b"]), odd).count() == 3


def test_toxicity_scores_against_brute_force(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, toxicity.learnable(labels))
    place = {int(b): k for k, b in enumerate(model.buckets)}
    assert len(place) > 20 and np.abs(model.factors).max() > 0
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        terms = set()
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            terms |= {zlib.crc32(w.encode()) % 2**22} | {zlib.crc32(w[:k].encode() + b"*") % 2**22 for k in range(4, 10) if len(w) >= k}
        at = [place[t] for t in sorted(terms) if t in place]
        z = model.bias + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(at) for j in at[:k])
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9), r.doc_id


def test_toxicity_sample_is_bounded_by_labels_not_rows(spark, docs_of):
    docs = docs_of([(1, "bad words"), (1, "bad words"), (1, "a"), (2, "good words"), (3, "x")])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 0)], "score long, predicted int, toxic int").withColumn("doc_id", __import__("pyspark").sql.functions.col("score"))
    assert toxicity.score_toxicity(docs, labels).count() == 5


def test_machine_learns_a_pair():
    rng = random.Random(2)
    rows = [[k for k in range(6) if rng.random() < 0.5] for _ in range(600)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    m = toxicity.fit(rows, y, np.arange(6), epochs=60)
    assert m.score([0, 1]) > 0.7 and m.score([0]) < 0.3 and m.score([1]) < 0.3
    x = np.array([[1.0, 1, 0, 0, 1, 0]])
    assert math.isclose(1 / (1 + math.exp(-m.decision(x)[0])), m.score([0, 1, 4]), rel_tol=1e-9)


def brute_base(rows):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0"] for i, t in rows}
    counts = collections.Counter()
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


@pytest.mark.parametrize("head", [4, 300_000])
def test_base_scores_against_brute_force(docs_of, head):
    rng = random.Random(3)
    kinds = [COMMON[:8], COMMON[8:]]  # a text keeps to one half of the words, which its context tells
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randrange(30, 90))) + rng.choice(["", " Rare%d" % i, " Ünï"])) for i in range(240)] + [(500 + k, t) for k, t in enumerate(ODD)]
    got = lm_scoring.lm_scores(docs_of(rows), crc_of_id() % 7 == 2, WORD, head_words=head, sample_rows=160).collect()
    want = brute_base(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0 and math.isfinite(r.score)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert head < 10 or sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_learns_from_rows_beyond_the_first_sample(docs_of):
    rng = random.Random(4)
    kinds = [COMMON[:8], COMMON[8:]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(400)]
    total = lambda n: sum(r.score for r in lm_scoring.lm_scores(docs_of(rows), crc_of_id() % 7 == 2, WORD, sample_rows=n).collect() if r.held_out)
    assert total(1) > 1.1 * total(400)  # the one row holds words of one kind only


def test_lm_score_is_that_of_the_whole_vocabulary_whatever_the_head(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice([*COMMON, "odd%d" % rng.randrange(40)]) for _ in range(40))) for i in range(80)] + [(500 + k, t) for k, t in enumerate(ODD[:5])]
    few, many = ({r.doc_id: r.score for r in lm_scoring.lm_scores(docs_of(rows), crc_of_id() % 7 == 2, WORD, head_words=n).collect()} for n in (4, 300_000))
    assert all(math.isclose(few[i], many[i], rel_tol=1e-5) for i in many)


def test_lm_beats_the_base_on_held_out_documents(spark):
    got = lm_scoring.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), crc_of_id() % 7 == 2, WORD).toPandas()
    for rows in (got[got.held_out], got[~got.held_out]):
        assert rows.score.sum() / rows.n_tokens.sum() > rows.base_score.sum() / rows.n_tokens.sum() + 0.02
        assert (rows.score > rows.base_score).mean() > 0.6


def brute_scores(texts, model, counts, n, norm):
    """Token by token: the mixture of the network's product over a word's ids and the word's smoothed share."""
    tok, out = lm_scoring.WordTokenizer(WORD), []
    for t in texts:
        words = [*lm_scoring.split_words(t), b""]
        ids = [np.frombuffer(tok._words([w.decode()])[0], np.uint32).tolist() for w in words[:-1]] + [[lm_scoring.END_ID]]
        flat = [i for w in ids for i in w]
        logs = []
        for at, target in enumerate(flat):  # its window, position by position
            first = at - at % lm_scoring.STRIDE
            seen = [lm_scoring.START_ID] * (lm_scoring.CONTEXT + 1) + flat
            x = seen[first : first + lm_scoring.CONTEXT + 1 + at % lm_scoring.STRIDE]
            h = model.weights["emb"][x].astype(float) + model.weights["pos"][: len(x)]
            s = (h[-1] @ model.weights["q"]) @ (h @ model.weights["k"]).T
            a = np.exp(s - s.max())
            z = (h[-1] + (a / a.sum()) @ (h @ model.weights["v"])) @ model.weights["out"] + model.weights["bias"]
            logs.append(z[model.class_of[target]] - z.max() - math.log(np.exp(z - z.max()).sum()) + model.within[target])
        total, at = 0.0, 0
        for w, part in zip(words, ids):
            p = math.exp(sum(logs[at : at + len(part)])) if part else 10**lm_scoring.NO_IDS
            at += len(part)
            mix = model.mix[min(lm_scoring.COUNT_SIZES - 1, int(counts.get(w, 0) + 1).bit_length() - 1)]
            total += math.log10(mix * p + (1 - mix) * (counts.get(w, 0) + 1) / norm)
        out.append(total)
    return out


def test_scores_against_brute_force():
    rng = np.random.default_rng(3)
    totals = rng.random(lm_scoring.IDS) * 9
    texts = ["the cat's river, Ünï 漢字 walks", "", " ".join(["bridge"] * 40), "a1 b2 c3 " * 15]
    streams_of = lambda head: zip(*[lm_scoring.TextEncoder(WORD, head).encode(t) for t in texts])
    words = {w for t in texts for w in lm_scoring.split_words(t)}
    head = {w: i for i, w in enumerate(sorted(words | {b""}), 1)}
    counts = {w: int(rng.integers(0, 300)) for w in head}
    streams, places, rare = streams_of(head)
    assert not any(rare)
    model = lm_scoring.train_model([lm_scoring._ids(s) for s in streams], totals, classes=9, width=4, epochs=3)
    model.mix = rng.random(lm_scoring.COUNT_SIZES)
    head_counts = np.array([0, *[counts[w] for w in sorted(head)]], float)
    lengths, _, base, scores, _ = lm_scoring.score_texts(model, head_counts, 5000.0, list(streams), list(places))
    assert np.allclose(scores, brute_scores(texts, model, counts, 0, 5000.0), rtol=1e-5)
    assert lengths.tolist() == [len(t.split()) + 1 for t in texts]
    model.weights = {k: v * 300 for k, v in model.weights.items()}  # no overflow at any weights
    assert np.isfinite(lm_scoring.score_texts(model, head_counts, 5000.0, list(streams), list(places))[3]).all()


def test_lm_without_training_rows_or_rows(docs_of):
    from pyspark.sql import functions as F

    got = lm_scoring.lm_scores(docs_of(["a b", None]), F.lit(True), WORD).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [3, 1] and all(r.base_score == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.lm_scores(docs_of([]), F.lit(False), WORD).count() == 0


def tiny_model():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 30, n) for n in (3, 70, 24, 25, 200, 1)]
    totals = np.bincount(np.concatenate(texts), minlength=lm_scoring.IDS).astype(float)
    return lm_scoring.train_model(texts, totals, classes=6, width=4, epochs=1), texts


def test_windows_score_each_id_once_and_see_no_future():
    model, texts = tiny_model()
    inputs, targets, sizes = model.windows(texts)
    assert np.concatenate([texts[k] for k in range(len(texts))]).tolist() == targets[targets >= 0].tolist() and sizes.tolist() == [len(t) for t in texts]
    logs = model.log_probs(inputs, targets)[targets >= 0]
    changed = [t.copy() for t in texts]
    changed[4][150:] = 29
    again = model.log_probs(*model.windows(changed)[:2])[model.windows(changed)[1] >= 0]
    start = sum(len(t) for t in texts[:4])
    assert np.allclose(logs[: start + 150], again[: start + 150], atol=1e-6)
    long = np.zeros((1, lm_scoring.STRIDE), np.int32)
    total = np.exp([model.log_probs(inputs[1:2], long + k)[0, 5] for k in range(0, 2000)]).sum()
    assert 0 < total <= 1 + 1e-5


def test_gradients_match_differences():
    model, texts = tiny_model()
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    inputs, targets, _ = model.windows(texts[:3])
    classes = np.where(targets < 0, -1, model.class_of[np.maximum(targets, 0)])

    def loss():
        m = lm_scoring.AttentionModel(model.class_of, np.zeros_like(model.within), w)
        return -m.log_probs(inputs, targets)[targets >= 0].astype(np.float64).mean()

    (met, g), rng = lm_scoring.gradients(w, inputs, classes), np.random.default_rng(1)
    assert g["emb"].shape == (len(met), 4) and set(met) == set(np.unique(inputs))
    w["emb"][met[0], 1] += 1e-2
    up = loss()
    w["emb"][met[0], 1] -= 2e-2
    down = loss()
    w["emb"][met[0], 1] += 1e-2
    assert abs((up - down) / 2e-2 - g["emb"][0, 1]) < 2e-3
    for name in ("q", "k", "v", "out", "bias", "pos"):
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        old, h = w[name][at], 1e-2
        w[name][at] = old + h
        up = loss()
        w[name][at] = old - h
        down = loss()
        w[name][at] = old
        assert abs((up - down) / (2 * h) - g[name][at]) < 2e-3


PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big, same = "é漢" * 20_000, "p" * 1000
    rows = [(1, "http://a/é b", big), (2, None, None), (3, "http://c", ""), (4, "u", same), (9, "u", same), (9, "u", same), (6, "u", same), (7, "u", "p" * 999), (8, "u", "p" * 999), (None, "u", same), (10, "x", "a\r\n\r\nWARC/1.1\r\n" * 3000)]
    monkeypatch.setattr(warc, "ROW_BYTES", 9_000)
    for compression in ("gzip", "none"):
        if compression == "none":
            monkeypatch.setattr("driftmesh.operators.common.BROADCAST_ROWS", 0)
        path = f"file://{tmp_path}/{compression}"
        warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), path, segment_bytes=4096, chunk_bytes=1000, rows_per_file=2, compression=compression)
        got = warc.read_warc(spark, path).collect()
        key = lambda r: (r[0] or 0, r[1])
        want = [(i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()), "revisit" if h == same and i != 9 else "response", 9 if h == same and i != 9 else None) for i, _, h in rows]
        assert sorted([(r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
        assert next(bytes(r.payload) for r in got if r.page_id == 1) == big.encode()
    heads = [f for file in tmp_path.glob("none/part-*") for f, _ in warc.parse_records(file.read_bytes())]
    names = {f["warc-record-id"] for f in heads if f["warc-type"] == "response"}
    assert sum(f["warc-type"] == "revisit" for f in heads) == 3 and all(f["warc-refers-to"] in names for f in heads if f["warc-type"] == "revisit")
    assert {f["warc-type"] for f in heads} == {"warcinfo", "response", "revisit", "continuation"}
    odd = spark.createDataFrame([(1, "u", "h" * 2000, "x", "y"), (2, "u", "h" * 2000, "x", "y")], "page_id long, url string, html string, hash string, largest string")
    assert sorted((r.page_id, r.record_type) for r in warc.warc_round_trip(odd).collect()) == [(1, "revisit"), (2, "response")]


def test_warc_faults_and_framing(spark):
    assert warc.dechunked(b"4;x=1\r\nabcd\r\n2\r\nef\r\n0\r\nT: 1\r\n\r\n") == b"abcdef"
    for payload in (b"", b"a", bytes(range(256)) * 40):
        assert warc.dechunked(warc.chunked(payload, 100)) == payload
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabcdXX0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    part = lambda n, b, t=None: ("o", n, t, "response", 1, None, "u", None, b)
    with pytest.raises(Exception, match="broken record"):
        warc.reassemble(spark.createDataFrame([part(1, b"ab"), part(3, b"cd", 4)], warc._SEGMENTS)).collect()
    ok = warc.reassemble(spark.createDataFrame([part(2, b"cd", 4), part(1, b"ab")], warc._SEGMENTS)).first()
    assert bytes(ok.block) == b"abcd"
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_pipeline_from_end_to_end(spark, labelled, docs_of, tmp_path):
    docs, labels = labelled
    rng = random.Random(9)
    clean = [(5000 + k, prose(rng, 80) + f" tail{k}") for k in range(20)]
    extra = [(6000, clean[0][1] + "\n"), (6001, clean[1][1] + "\n"), (6002, "my password = hunter2222 ok"), (6003, None), (6004, "")]
    docs.unionByName(docs_of(clean + extra)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    frame, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, sf)
        seen[name] = frame.toPandas()
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    assert not toxic & set(seen["toxicity"].doc_id) and set(range(5000, 5020)) <= set(seen["toxicity"].doc_id)
    ids = set(seen["exact_dedup"].doc_id)
    assert 6000 in ids and 5000 not in ids and len(ids & {6003, 6004, 1000, 1001, 1002}) == 1
    assert set(seen["secret_scan"].doc_id) == set(seen["simhash_dedup"].doc_id)
    text = seen["secret_scan"].set_index("doc_id")
    assert text.text[6002] == "my [SECRET] ok" and text.n_chars[6002] == len("my [SECRET] ok")
    assert set(seen["packing"].doc_id) == set(seen["secret_scan"].doc_id)
    whole = corpus_pipeline.run(spark, sf).toPandas()  # its tables are cut otherwise, so its sequences may be
    assert set(whole.doc_id) == set(seen["packing"].doc_id) and whole.length.sum() == seen["packing"].length.sum()


def test_stages_take_any_columns_and_edge_rows(spark, labelled, tmp_path):
    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "spans", "secret_base", "own_sha", "copy_id", "gone", "met", "doc_id", "text", "salt"]
    texts = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "token = abcdefgh " * 3), (None, "x"), (5, "word " * 5000)]
    df = spark.createDataFrame([(*["q"] * 7, i, t, "s") for i, t in texts], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == names, name
            kept = {r.doc_id for r in out.collect()}
            assert kept == (set() if docs is not df else {1, 3, 4, None, 5} if name in ("exact_dedup", "simhash_dedup") else {1, 2, 3, 4, None, 5}), name
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_pipeline_on_empty_tables(spark, labelled, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    labelled[1].write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lm_mixture_is_fitted_to_all_training_tokens(docs_of, monkeypatch):
    rng = random.Random(21)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60)))) for i in range(200)]
    fit, seen = lm_scoring.fit_mix, []
    monkeypatch.setattr(lm_scoring, "fit_mix", lambda tokens, *rest: seen.append(tokens) or fit(tokens, *rest))
    for head in (3, 300_000):
        got = lm_scoring.lm_scores(docs_of(rows), crc_of_id() % 7 == 2, WORD, head_words=head, sample_rows=5).collect()
        assert seen[-1].sum() == got[0].train_tokens
    of_count = [t.reshape(lm_scoring.COUNT_SIZES, -1).sum(axis=1).tolist() for t in seen]
    assert of_count[0] == of_count[1] and sum(map(bool, of_count[0])) > 3


def test_lm_texts_are_written_as_places_and_read_back_whole():
    texts = ["the cat's river, Ünï 漢字 walks", "", " ".join(["bridge"] * 40), "a1 b2 c3 " * 15, "only rare", "\x00 <|endoftext|> x"]
    known = sorted({w for t in texts[:4] for w in lm_scoring.split_words(t)} | {b""}) + [b"bridge%d" % k for k in range(70_000)]
    for words in (known, known[1:3]):  # without the end of text among them, too
        encoder = lm_scoring.TextEncoder(WORD, {w: i for i, w in enumerate(words, 1)})
        plain = [np.frombuffer(lm_scoring.TextEncoder(WORD, {}).encode(w.decode())[0], np.uint16) if w else np.array([lm_scoring.MARK, lm_scoring.END_ID] * 2, np.uint16) for w in words[:40]]
        head = lm_scoring.HeadWords.of([s[s != lm_scoring.MARK][:-1].tobytes() for s in plain])
        places, streams, rare = zip(*[encoder.places(t) for t in texts])
        wanted = [encoder.encode(t) for t in texts]
        ids, sizes, lengths, at = head.expand(list(places), list(streams))
        assert ids.tolist() == [i for s, _, _ in wanted for i in lm_scoring.read_stream(s)[0]] and sizes.tolist() == [n for s, _, _ in wanted for n in lm_scoring.read_stream(s)[1]]
        assert lengths.tolist() == [len(t.encode().split()) + 1 for t in texts] and at.tolist() == np.frombuffer(b"".join(p for _, p, _ in wanted), np.uint32).tolist()
        assert [t.tolist() for t in head.texts(list(places), list(streams))] == [lm_scoring.read_stream(s)[0].tolist() for s, _, _ in wanted] and list(rare) == [r for _, _, r in wanted]
    numbers = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert lm_scoring.from_planes(lm_scoring.to_planes(numbers)).tolist() == numbers.tolist() and lm_scoring.to_planes(numbers[:2]) == b"\0" * 7 + b"\1"
    logs = -np.array([0.0, 1e-6, 3.7, 500.0])
    assert np.abs(lm_scoring.kept(logs) / -lm_scoring.KEPT_STEPS - logs).max() <= 0.5 / lm_scoring.KEPT_STEPS and lm_scoring.kept(np.array([-1e9])) == 2**32 - 1
