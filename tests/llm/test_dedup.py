import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from driftmesh.llm import exact_dedup as E
from driftmesh.llm import simhash as S
from driftmesh.llm.common import connected_components

from .conftest import ODD


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for k in (0, 1, 7, 40, 59):
        v = np.sort(rng.integers(0, 1 << min(60, k + 4), 500, dtype=np.uint64))
        assert (E.golomb_decode(E.golomb_encode(v, k), len(v), k) == v).all()
    assert E.golomb_encode(np.zeros(0, np.uint64), 5) == b"" and len(E.golomb_decode(b"", 0, 5)) == 0


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        group = [(j, u or "") for (j, u), m in zip(rows, norm) if m == n]
        best = max(len(u) for _, u in group)
        ids = [j for j, u in group if len(u) == best and j is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(group), len(t or "") == best and i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact_against_brute_force(docs_of):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, rng.choice(["ab c", "a bc", "abc", "d", "e f", " abc "])) for i in range(60)]
    rows += [(500, "only"), (500, "only"), (None, "nobody"), (None, "abc")]
    for blocks in (7, 50_000):
        got = E.exact_dedup(docs_of(rows).repartition(5), block_rows=blocks).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(brute_exact(rows), key=key)


def test_exact_empty_table_and_extra_columns(spark, docs_of):
    assert E.exact_dedup(docs_of([])).count() == 0
    df = spark.createDataFrame([(1, "a", 9, "x"), (2, "a ", 9, "y")], "doc_id long, text string, n_chars int, hash string").withColumnsRenamed({"n_chars": "owner"})
    assert {r.doc_id: r.kept for r in E.exact_dedup(df).collect()} == {1: False, 2: True}
    assert E.drop_copies(df).collect()[0].hash == "y"


def test_copies_whatever_the_columns_are_called(spark):
    names = ["own_sha", "copy_id", "copy_sha", "hash", "kept", "doc_id", "text", "suspect_id", "stays", "times"]
    df = spark.createDataFrame([(*["q"] * 5, i, t, *["r"] * 3) for i, t in [(1, "a b"), (2, "ab"), (3, "c"), (1, "a b")]], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    got = E.drop_copies(df).collect()
    assert E.drop_copies(df).columns == names and sorted((r.doc_id, r.own_sha, r.times) for r in got) == [(1, "q", "r"), (3, "q", "r")]
    assert E.drop_copies(df.limit(0)).count() == 0


def test_exact_over_salted_look_ups_and_shuffled_bitmaps(docs_of, broadcast_rows, monkeypatch):
    monkeypatch.setattr(E, "BITMAP_BYTES", 0)
    rows = [(i, random.Random(i % 7).choice(["ab c", "a bc", "d", "e f"])) for i in range(80)] + [(None, "ab c"), (90, None)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, E.exact_dedup(docs_of(rows).repartition(4), block_rows=9).collect()), key=key) == sorted(brute_exact(rows), key=key)


def test_only_one_of_repeated_rows_stays(docs_of):
    got = E.drop_copies(docs_of([(1, "a b"), (1, "a b"), (2, "ab"), (3, "z"), (3, "y"), (None, "q"), (None, "q")])).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == [(0, "q"), (1, "a b"), (3, "y"), (3, "z")]


def brute_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force(docs_of):
    texts = [t for t in ODD if t is None or len(t) < 20_000] + ["A b C d", "a B c D", "one two", "One  two\n", "α Β γ δ Ε"]
    for k in (3, 5):
        got = {r.doc_id: r["print"] & (2**64 - 1) for r in S.fingerprints(docs_of(texts), k).collect()}
        assert got == {i: brute_print(t, k) for i, t in enumerate(texts)}


def brute_roots(prints, radius):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_tiles_lose_no_link(spark):
    rng = random.Random(4)
    prints = [0, 2**64 - 1]
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(rng.randrange(4)):  # chains of near prints
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                base ^= 1 << b
            prints.append(base)
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    want = brute_roots(prints, 3)
    for tile_rows in (3, 8192):
        edges = S.links(spark.createDataFrame([(s,) for s in signed], "print long"), 3, tile_rows)
        root = {r.node: r.root for r in connected_components(edges).collect()}
        got = [root.get(s, s) for s in signed]
        groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
        assert groups(got) == groups(want)


def test_components_name_the_least_id_and_one_stays(docs_of):
    base = [f"w{i}" for i in range(400)]
    near = [*base[:-1], "other"]
    rows = [(7, " ".join(base)), (3, " ".join(base) + "\n"), (9, " ".join(near)), (5, "something else altogether here"), (None, None), (8, "")]
    got = {r.doc_id: r.component_id for r in S.simhash_components(docs_of(rows), 3, 3).collect()}
    assert got == {7: 3, 3: 3, 9: 3, 5: 5, None: 8, 8: 8}
    assert sorted(r.doc_id for r in S.drop_near_copies(docs_of(rows), 3, 3).collect()) == [3, 5, 8]
    assert S.simhash_components(docs_of([])).count() == 0


def test_a_large_near_group_gives_few_edges(spark):
    prints = [(1 << i) | (1 << j) for i in range(40) for j in range(i)]
    edges = S.links(spark.createDataFrame([(p,) for p in prints], "print long"), 3, 100)
    assert edges.count() < 20 * len(prints)
    assert len({r.root for r in connected_components(edges).collect()}) == 1


@pytest.fixture(params=[2_000_000, 0], ids=["broadcast", "salted"])
def broadcast_rows(request, monkeypatch):
    """Both ways of every join that depends on a size."""
    from driftmesh.operators import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", request.param)
    monkeypatch.setattr(S, "HUB_EDGES", 3)
    return request.param


def brute_similar(rows, k, similarity):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and (len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9):
                a, b = sorted((label[i], label[j]))
                label = {x: a if y == b else y for x, y in label.items()}
    return label


def test_similar_documents_against_brute_force(docs_of, broadcast_rows):
    rng, rows = random.Random(3), []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(rng.choice([3, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 9)):  # a chain of copies, each with a few changes more
            for at in rng.sample(range(len(words)), rng.choice([0, 1, 1, 3])):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    base = [f"h{i}" for i in range(200)]
    for k in range(30):  # a hub: copies of one text, each with its own change
        rows.append((1000 + k, " ".join(base[: 6 * k] + [f"z{k}"] + base[6 * k + 1 :])))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "Ab c"), (2004, "aB  C"), (2005, "word " * 4000), (2006, "word " * 9000)]
    rng.shuffle(rows)
    want = brute_similar(rows, 5, 0.8)
    for tile_rows in (4, 8192):
        got = {r.node: r.root for r in S.similar_components(docs_of(rows).repartition(3), tile_rows=tile_rows).collect()}
        assert {i: got.get(i, i) for i in want} == want
    assert {r.doc_id for r in S.drop_similar(docs_of(rows)).collect()} == set(want.values())


def test_forest_prefers_the_least_distances():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, m = 12, 40
        u, v, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 4, m)
        chosen = S.spanning_forest(u, v, d, n)
        label, total = list(range(n)), 0
        for e in np.argsort(d, kind="stable"):  # Kruskal one by one
            a, b = label[u[e]], label[v[e]]
            if a != b:
                total += d[e]
                label = [a if x == b else x for x in label]
        assert d[chosen].sum() == total and len(chosen) == n - len(set(label))


def test_near_copies_whatever_the_columns_are_called(spark):
    text = " ".join(f"w{i}" for i in range(50))
    names = ["gone", "met", "print", "key", "u", "v", "root", "doc_id", "text", "salt"]
    df = spark.createDataFrame([(*["q"] * 7, i, t, "s") for i, t in [(4, text), (2, text + " "), (None, text), (9, "else")]], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    for drop, want in ((S.drop_similar, [0, 2, 9]), (S.drop_near_copies, [2, 9])):
        got = drop(df)
        assert got.columns == names and sorted(r.doc_id or 0 for r in got.collect()) == want
        assert drop(df.limit(0)).count() == 0


def test_components_over_salted_look_ups(docs_of, broadcast_rows):
    base = [f"w{i}" for i in range(400)]
    rows = [(7, " ".join(base)), (3, " ".join(base) + "\n"), (9, " ".join([*base[:-1], "other"])), (5, "something else altogether here"), (None, None), (8, ""), (8, "")]
    got = sorted(((r.doc_id or 0, r.component_id) for r in S.simhash_components(docs_of(rows), 3, 3).collect()))
    assert got == [(0, 8), (3, 3), (5, 5), (7, 3), (8, 8), (8, 8), (9, 3)]


def test_quarters_as_cells_lose_no_link(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                p ^= 1 << b
            prints.append(p)
    signed = [p - 2**64 if p >= 2**63 else p for p in dict.fromkeys(prints)]
    frame = spark.createDataFrame([(s,) for s in signed], "print long")
    roots = [{r.node: r.root for r in connected_components(S.links(frame, 3, 5, parts)).collect()} for parts in (2, 4)]
    assert roots[0] == roots[1]


def test_links_beside_a_refuted_edge_of_the_forest_are_kept(docs_of):
    rng = random.Random(11)
    sketch = lambda t: (lambda rows: (S.wide_print(rows), set(map(bytes, rows))))(S.shingle_rows(t, 5))
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[0], b[0]))
    alike = lambda a, b: len(a[1] & b[1]) / len(a[1] | b[1])
    texts = []
    while len(texts) < 9:  # x and y are linked, w and y too; w is nearer to x than y is, but not similar to it
        x = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        y = [*x[:20], "other", *x[21:]]
        w = [*y[:40], "third", *y[41:]]
        a, b, c = (sketch(" ".join(t)) for t in (x, y, w))
        if apart(a, c) < apart(a, b) <= S.WIDE_RADIUS and apart(b, c) < apart(a, b) and alike(a, c) < 0.8 <= min(alike(a, b), alike(b, c)):
            texts += [" ".join(t) for t in (x, y, w)]
    got = {r.node: r.root for r in S.similar_components(docs_of(texts)).collect()}
    assert got == {i: i // 3 * 3 for i in range(9)}


def test_a_group_of_refuted_links_gives_few_rows(docs_of, monkeypatch):
    rng, base = random.Random(12), [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):  # alike by 0.7 or so, near in their fingerprints: hardly any pair is a link, most are candidates
        words = list(base)
        for at in rng.sample(range(0, 100, 8), 3):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, t + " tail") for k, t in rows[:20]]  # each links with its own original
    want = brute_similar(rows, 5, 0.8)
    assert len(set(want.values())) > 20
    made, plain = [], S.missing_links
    monkeypatch.setattr(S, "missing_links", lambda *a: made.append(plain(*a)) or made[-1])
    for tile_shingles in (400, S.TILE_SHINGLES):
        got = {r.node: r.root for r in S.similar_components(docs_of(rows).repartition(3), tile_shingles=tile_shingles).collect()}
        assert {i: got.get(i, i) for i in want} == want
    assert len(made) == 2 and made[1].count() < len(rows)


def test_joining_links_against_all_pairs():
    rng = np.random.default_rng(13)
    for _ in range(20):
        sets = [np.unique(rng.choice(40, rng.integers(0, 12))) if rng.random() < 0.3 else np.delete(np.arange(30), rng.choice(30, rng.integers(0, 5), replace=False)) for _ in range(30)]
        roots = rng.integers(0, 25, 30)
        tile = lambda at: (at, np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), np.array([len(sets[i]) for i in at], float), roots[at], [sets[i] for i in at])
        links = [(i, j) for i in range(30) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]

        def groups(edges):
            label = roots.copy()
            for i, j in edges:
                label[label == label[i]] = label[j]
            return [[label[i] == label[j] for i in range(30)] for j in range(30)]

        every = np.arange(30)
        got = list(zip(*S.joining_links(tile(every), None, 28, 0.8)))
        assert groups(got) == groups(links) and len(got) < len(set(roots)) and set(got) <= {(i, j) for a, b in links for i, j in ((a, b), (b, a))}
        got = list(zip(*S.joining_links(tile(every[:12]), tile(every[12:]), 28, 0.8)))
        assert groups(got) == groups([(i, j) for i, j in links if (i < 12) != (j < 12)])
