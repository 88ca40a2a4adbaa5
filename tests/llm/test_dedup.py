import dataclasses
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import common, lines, passages, simhash
from ledgerline.llm.graph import components, forest, spanning

from .conftest import ODD


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest(edges):
    a, b = forest(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))
    nodes = {n for e in edges for n in e}
    assert union(zip(a.tolist(), b.tolist()), nodes) == union(edges, nodes)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(200)] + [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(120)] + [(700, 700)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(edges, {n for e in edges for n in e})
    assert got == {n: c for n, c in want.items() if n != 700}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_contract(spark, odd, nothing):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in ODD] + [(1000 + 10 * k + c, " ".join(["new"] * c + t.split()[c:])) for k, t in enumerate(texts) for c in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], int(r["fp"].hex(), 16), r["component_id"]) for r in simhash.near_duplicates(docs, simhash.EXACT).collect())
    prints = [(i, exact_print(t)) for i, t in rows]
    reps = {}
    for i, f in prints:
        if i is not None:
            reps[f] = min(reps.get(f, i), i)
    linked = [(reps[a], reps[b]) for a in reps for b in reps if (a ^ b).bit_count() <= 4]
    comp = union(linked, set(reps.values()))
    assert got == Counter((i, f, comp[reps[f]] if f in reps else None) for i, f in prints)
    assert simhash.near_duplicates(odd, simhash.EXACT).count() == len(ODD) and simhash.near_duplicates(nothing, simhash.EXACT).count() == 0


def test_many_slices_find_the_same(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = np.concatenate([base, base ^ np.uint64(0b1011 << 20), base ^ np.uint64(1 << 50)])
    for p in (simhash.EXACT, dataclasses.replace(simhash.EXACT, slices=1, block=5000), dataclasses.replace(simhash.EXACT, slices=4096)):
        nodes = spark.createDataFrame([(i, int(k).to_bytes(8, "big")) for i, k in enumerate(keys.tolist())], "rep long, fp binary")
        found = {(r["a"], r["b"]) for r in simhash.links(nodes, p).collect()}
        assert union(found, range(len(keys))) == {i: i % 40 for i in range(len(keys))}


def test_near_copies_go_and_others_stay(spark, odd, nothing):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    rows, first = [], set()
    for k in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        rows.append((10 * k, " ".join(t)))
        first.add(10 * k)
        for c in (1, 2):
            e = list(t)
            for _ in range(max(1, len(t) // 60)):
                e[rng.randrange(len(e))] = "edit"
            rows.append((10 * k + c, " ".join(e)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == first
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 5, 6, 8, 9}
    assert 7 not in {r["doc_id"] for r in kept.collect()} and simhash.first_of_each(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 255), max_size=60), min_size=1, max_size=14), st.integers(1, 4))
def test_no_link_of_a_collision_group_is_lost(flipped, kinds):
    p = simhash.NEAR
    checks = np.zeros((len(flipped) + 3, 256), np.uint8)
    checks[1, :50], checks[2, :70] = 1, 1  # 0 and 2 are far apart, 1 is near both
    for row, at in zip(checks[3:], flipped):
        row[at] ^= 1
    n = len(checks)
    words = np.packbits(checks, axis=1, bitorder="little").view("<u8")
    keys = np.array([0, 0xFF, 0xFF00, 0xFF0000], np.uint64)[np.arange(n) % kinds]
    p = dataclasses.replace(p, slices=1)
    x, y = simhash.collisions(keys, words, 0, p)
    far = (checks[:, None] != checks[None]).sum(axis=2)
    assert (far[x, y] <= p.check).all() and (keys[x] == keys[y]).all()
    linked = [(a, b) for a in range(n) for b in range(a) if keys[a] == keys[b] and far[a, b] <= p.check]
    assert union(zip(x.tolist(), y.tolist()), range(n)) == union(linked, range(n))


def similar_pairs(texts, least=0.8):
    """All pairs of ids whose sets of five-word shingles are so similar, through an index of all shingles."""
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())((t or "").encode().lower().split()) for i, t in texts}
    held, shared = {}, Counter()
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    for own in held.values():
        shared.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    return {(min(a, b), max(a, b)) for (a, b), n in shared.items() if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 58)), max_size=60))
def test_certificates_keep_what_is_connected(edges):
    edges = sorted({(min(a, b), max(a, b)): w for a, b, w in edges if a != b}.items())
    x, y, far = (np.array(v, np.int64) for v in ([e[0][0] for e in edges], [e[0][1] for e in edges], [e[1] for e in edges]))
    own = simhash.certificate(x, y, far, simhash.NEAR)
    pairs = list(zip(x.tolist(), y.tolist()))
    for limit in (simhash.NEAR.sure, 58):
        some = [pairs[i] for i in own if far[i] <= limit]
        assert union(some, range(13)) == union([p for p, w in zip(pairs, far) if w <= limit], range(13))
    assert len(set(own.tolist())) == len(own) <= 12 * (1 + simhash.NEAR.spare)
    tree = spanning(x, y, far)
    assert far[tree].sum() == least_tree(pairs, far)


def least_tree(pairs, far):
    total, kept = 0, []
    for i in np.argsort(far, kind="stable").tolist():
        up = union(kept, range(13))
        if up[pairs[i][0]] != up[pairs[i][1]]:
            kept.append(pairs[i])
            total += far[i]
    return total


def test_families_of_edited_copies_stay_together(spark):
    rng = random.Random(22)
    rows = []
    for k in range(3):
        whole = [f"u{rng.randint(0, 10**7)}" for _ in range(150)]
        for c in range(300):
            w = list(whole)
            for at in rng.sample(range(150), rng.randint(0, 2)):  # copies of one original; two of them may be under 0.8
                w[at] = f"edit{rng.random()}"
            rows.append((1000 * k + c, " ".join(w)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r["doc_id"] // 1000, r["component_id"]) for r in found.collect()} == {(k, 1000 * k) for k in range(3)}


def test_no_candidate_between_parts_is_left(spark):
    rng = random.Random(23)
    texts = []
    for k in range(6):  # families in which most pairs are a little under 0.8
        whole = [f"u{rng.randint(0, 10**7)}" for _ in range(150)]
        for c in range(40):
            w = list(whole)
            for at in rng.sample(range(0, 150, 5), rng.choice((1, 2, 3, 3))):
                w[at] = f"edit{rng.random()}"
            texts.append((1000 * k + c, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for p in (simhash.NEAR, dataclasses.replace(simhash.NEAR, spare=1, sure=10, side=7, most=1)):
        prints = {r["doc_id"]: np.frombuffer(r["fp"], ">u8").astype(np.uint64) for r in simhash.fingerprints(docs, p).collect()}
        apart = {q: np.bitwise_count(prints[q[0]] ^ prints[q[1]]).astype(int) for q in similar_pairs(texts)}
        linked = [q for q, d in apart.items() if d[: p.tables].min() <= p.radius and d[p.tables :].sum() <= p.check]
        want = union(linked, [i for i, _ in texts])
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, p).collect()}
        assert got == want and 6 < len(set(want.values())) < 230


def test_edges_grow_with_the_documents_of_a_group(spark, monkeypatch):
    rng = random.Random(24)
    whole = [f"u{rng.randint(0, 10**7)}" for _ in range(600)]
    texts = []
    for c in range(200):  # nearly all pairs are candidates of a similarity under 0.8
        w = list(whole)
        for at in rng.sample(range(0, 600, 5), 9):
            w[at] = f"edit{rng.random()}"
        texts.append((c, " ".join(w)))
    texts += [(1000, texts[7][1] + " more words"), (1001, texts[9][1].replace("edit", "other", 1))]
    seen = []
    monkeypatch.setattr(simhash, "components", lambda edges: seen.append(edges.count()) or components(edges))
    found = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert got == union(similar_pairs(texts), [i for i, _ in texts])
    assert max(seen) <= 10 * len(texts)


def test_links_that_join_parts(spark):
    rng = random.Random(25)
    rows, kinds = [], []
    for k in range(3):
        whole = [f"u{rng.randint(0, 10**7)}" for _ in range(150)]
        for c in range(30):
            w = list(whole)
            for at in rng.sample(range(0, 150, 5), rng.choice((1, 2, 3))):
                w[at] = f"edit{rng.random()}"
            rows.append(" ".join(w).encode())
            kinds.append(k)
    sets = simhash.shingle_sets(pa.array([r.decode() for r in rows]), 5)
    prints = [simhash.near_fingerprint(s, simhash.NEAR).astype(">u8") for s in sets]
    near = lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).astype(int)
    want = []
    for a in range(90):
        for b in range(a):
            d, n = near(a, b), len(np.intersect1d(sets[a], sets[b]))
            if kinds[a] == kinds[b] and d[:24].min() <= 4 and d[24:].sum() <= 58 and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                want.append((a, b))
    for most in (1, 192):
        for side, pairs in (([0] * 90, want), ([i % 2 for i in range(90)], [(a, b) for a, b in want if (a - b) % 2])):
            some = [i for i in range(90) if len(set(side)) == 1 or kinds[i] == 1]  # two sides are of one whole
            t = pa.table({"whole": [kinds[i] for i in some], "part": pa.array(some, pa.int64()), "side": [side[i] for i in some], "fp": [prints[i].tobytes() for i in some], "shingles": [sets[i].view(np.int64).tolist() for i in some]})
            a, b = simhash.joined(t, dataclasses.replace(simhash.NEAR, most=most))
            assert union(zip(a.tolist(), b.tolist()), some) == union([q for q in pairs if q[0] in some], some)
            assert 0 < len(a) < len(some)


def test_near_duplicates_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(21)  # and pairs of each similarity around 0.8
    for k in range(300):
        w = [f"u{rng.randint(0, 10**7)}" for _ in range(rng.randint(40, 300))]
        texts.append((10**6 + 2 * k, " ".join(w)))
        for at in rng.sample(range(len(w)), max(1, round(len(w) * rng.choice((0.01, 0.015, 0.02, 0.025))))):
            w[at] = f"edit{at}"
        texts.append((10**6 + 2 * k + 1, " ".join(w)))
    pairs = similar_pairs(texts)
    want = union(pairs, [i for i, _ in texts])
    found = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in found.collect()}
    lost = [p for p in pairs if got[p[0]] != got[p[1]]]
    print(len(pairs), len(lost))
    assert len(lost) <= 0.005 * len(pairs)
    assert all(want[i] == want[c] for i, c in got.items() if (dict(texts)[i] or "").split())


def kept_lines(rows):
    held = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(i)
    out = Counter()
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out[i, len(parts), len(parts) - len(stay), "\n".join(stay)] += 1
    return out


def test_line_dedup(spark, odd, nothing):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in lines.dedup_lines(odd.drop("keys"), counts=True).collect())
    assert got == kept_lines(ODD)
    assert lines.dedup_lines(odd).columns == odd.columns and lines.dedup_lines(nothing).count() == 0


def test_line_counts_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a long shared line", "x", 7), (2, "own words\na long shared line", "y", 8)], "doc_id long, text string, n_lines string, n_dropped int")
    got = lines.dedup_lines(docs, counts=True)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == [(1, "a long shared line", 1, 0), (2, "own words", 2, 1)]
    assert lines.dedup_lines(docs).columns == docs.columns


def state(index):
    return (
        Counter(map(tuple, index.postings.select("doc_id", "h1", "h2").collect())),
        set(map(tuple, index.shared.select("h1", "h2", "owner", "refs").collect())),
    )


def test_line_index_is_reversible(spark):
    rows = [(i, f"a shared line {i % 3}\nown line number {i}\nanother shared {i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lines.build(docs.filter("doc_id < 8"), shards=4)
    two = lines.insert(one, docs.filter("doc_id >= 8"))
    assert state(two) == state(lines.build(docs, shards=4))
    back = lines.delete(two, docs.filter("doc_id >= 8").select("doc_id"))
    assert state(back) == state(one)
    less = lines.delete(back, docs.filter("doc_id < 3").select("doc_id"))
    assert state(less) == state(lines.build(docs.filter("doc_id between 3 and 7"), shards=4))
    for index in (two, back, less):  # every shared key is in its shard's filter
        slots = {r["shard"]: lines.Cuckoo.from_bytes(bytes(r["slots"])) for r in index.filters.collect()}
        for r in index.shared.select(index.shard().alias("s"), "h1").collect():
            assert slots[r["s"]].contains(np.array([r["h1"]], np.int64).view(np.uint64))[0]


def test_lines_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in lines.dedup_lines(docs, counts=True).collect()) == kept_lines(ODD)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300))
def test_cuckoo(hashes):
    own = lines.Cuckoo.of(np.array(hashes, np.uint64))
    if hashes:
        assert own.contains(np.array(hashes, np.uint64)).all()
    for h in hashes[::2]:
        assert own.delete(h)
    if hashes[1::2]:
        assert own.contains(np.array(hashes[1::2], np.uint64)).all()


def test_chains_equal_quadratic_chaining():
    r, rng = passages.PassageRules(most_gap=10**9), random.Random(8)
    for _ in range(40):
        pts = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 25))})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        f = []
        for i, (a, b) in enumerate(pts):
            f.append(r.weight + max([0.0] + [f[j] - r.gap_cost * (a - c + b - d) for j, (c, d) in enumerate(pts[:i]) if c < a and d < b]))
        best = passages.chains_of(x, y, r)[0]
        cost = r.gap_cost * (best[0][-1] - best[0][0] + best[1][-1] - best[1][0])
        assert abs(len(best[0]) * r.weight - cost - max(f)) < 1e-6
        assert (np.diff(best[0]) > 0).all() and (np.diff(best[1]) > 0).all()


def planted():
    rng = random.Random(3)
    fresh = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, truth = [], {}
    for p in range(12):
        whole = fresh(80)
        for c in range(3):
            q = list(whole)
            if c == 2:
                for k in (20, 45, 60):
                    q[k] = f"edit{k}"
                del q[30]
            before, after = fresh(rng.randint(0, 150)), fresh(rng.randint(0, 150))
            i = 100 + 10 * p + c
            rows.append((i, " ".join(before + q) + "\n" + " ".join(after)))
            if c:
                truth[i] = (len(before), len(before) + len(q), 100 + 10 * p)
    return rows, truth


def test_passages(spark, odd, nothing):
    rows, truth = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.passages(docs)
    got = {r["doc_id"]: (r["begin"], r["end"], r["source_id"]) for r in found.collect()}
    assert set(got) == set(truth)
    for i, (a, z, s) in truth.items():
        assert abs(got[i][0] - a) <= 2 and abs(got[i][1] - z) <= 2 and got[i][2] == s
    left = {r["doc_id"]: r["text"].split() for r in passages.drop_passages(docs, found).collect()}
    for i, t in rows:
        w = t.split()
        assert left[i] == (w if i not in got else w[: got[i][0]] + w[got[i][1] :])
    own = passages.passages(odd)
    assert {(r["doc_id"], r["source_id"]) for r in own.collect()} == {(7, 6)}
    kept = passages.drop_passages(odd, own)
    assert kept.columns == odd.columns and kept.count() == odd.count() and passages.passages(nothing).count() == 0


def test_keys_meet_in_shares_of_little_memory():
    rng = np.random.default_rng(4)
    made = lambda: [(rng.integers(0, 20000, 10000).astype(np.uint64) * common.ODD & passages.KEY_BITS, rng.integers(0, 50000, 10000), rng.integers(0, 2000, 10000).astype(np.int32)) for _ in range(50)]
    pieces = made()
    want = passages.met(*(np.concatenate(c) for c in zip(*pieces)))
    held = [list(c) for c in zip(*pieces)]
    size = sum(v.nbytes for c in pieces for v in c)
    del pieces
    got = list(passages.met_in_shares(held))
    rows = lambda parts: Counter(zip(*(np.concatenate(c).tolist() for c in zip(*parts))))
    assert len(got) > 1 and rows(got) == rows([want])
    held = [list(c) for c in zip(*made())]
    tracemalloc.start()
    assert sum(len(found[0]) for found in passages.met_in_shares(held)) > 400_000
    assert tracemalloc.get_traced_memory()[1] < 2.5 * size
    tracemalloc.stop()


def test_passages_by_shuffle(spark, monkeypatch):
    rows, truth = planted()
    monkeypatch.setattr(common, "BROADCAST_IDS", -1)
    assert {r["doc_id"] for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(truth)


def found_share(spark, texts):
    """The share of pairs (2 i, 2 i + 1) of texts of which the later one is found to have the earlier one's passage."""
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["source_id"]) for r in passages.passages(docs).collect()}
    return sum((1001 + i, 1000 + i) in got for i in range(0, len(texts), 2)) / (len(texts) // 2)


def test_passages_with_spread_edits(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    for n, every in ((60, 5), (60, 6), (60, 8), (60, 10)):
        texts = []
        for _ in range(40):
            whole = fresh(n)
            edited = [f"edit{rng.random()}" if i % every == every - 1 else w for i, w in enumerate(whole[:-1])] + whole[-1:]
            texts += [" ".join(fresh(30) + whole + fresh(30)), " ".join(fresh(40) + edited + fresh(20))]
        assert found_share(spark, texts) == 1, every


def test_passages_with_random_edits(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    for edits in (6, 9):
        texts = []
        for _ in range(100):
            whole = fresh(60)
            at = set(rng.sample(range(1, 59), edits))
            texts += [" ".join(fresh(30) + whole + fresh(30)), " ".join(fresh(40) + [f"edit{i}{rng.random()}" if i in at else w for i, w in enumerate(whole)] + fresh(20))]
        share = found_share(spark, texts)
        print(edits, share)
        assert share >= 0.97, edits


def test_passages_of_phrases_that_smaller_documents_hold(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    whole = fresh(60)
    rows = [(i, " ".join(fresh(20) + whole[i : i + n] + fresh(20))) for n in (5, 9, 12) for i in range(60 - n)]
    docs = [(i, t) for i, (_, t) in enumerate(rows)] + [(500, " ".join(fresh(20) + whole + fresh(9))), (501, " ".join(fresh(7) + whole))]
    found = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"], r["end"] - r["begin"]) for r in found} == {(501, 500, 60)}


def test_near_copies_report_a_passage_once(spark):
    rng = random.Random(9)
    whole = [f"u{rng.randint(0, 10**7)}" for _ in range(200)]
    rows = [(i, " ".join(rng.choice("abc") + w if rng.random() < 0.04 and 10 < n < 190 else w for n, w in enumerate(whole))) for i in range(60)]
    found = Counter(r["doc_id"] for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {i: 1 for i in range(1, 60)}


def test_words_of_slices():
    texts = pa.array(["Aa  b", None, " C\td\x1ce ", "", "f"] * 5, pa.string())
    for own in (texts, texts.slice(3, 11), texts.slice(24)):
        h, at = passages.hashed_words(own)
        want = [[xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().lower().split()] for t in own.to_pylist()]
        assert [h[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=60), min_size=1, max_size=5))
def test_seeds_equal_those_of_each_text(texts):
    r = passages.PassageRules()
    words = [np.array(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    h, row, at = passages.seeds_of(np.concatenate(words), starts, r)
    got = Counter(zip(h.tolist(), row.tolist(), at.tolist()))
    want = Counter()
    for i, w in enumerate(words):
        short = (passages.rolled(w, [0, 1, 2, 3, 5, 6, 7, 8]) & ~np.uint64(1)).tolist()
        for j, k in enumerate(short):
            if k not in short[max(0, j - r.turn) : j] or k not in short[j + 1 : j + 1 + r.turn]:
                want[k, i, j] += 1
        long = passages.rolled(w, list(range(20)))
        for j in {j for a in range(max(1, len(long) - 11)) for j in range(a, min(a + 12, len(long))) if long[j] == long[a : a + 12].min()}:
            want[int(long[j]) | 1, i, j] += 1
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 12)), max_size=25))
def test_least_cover(spans):
    spans = sorted((a, a + n) for a, n in spans)
    kept = [spans[i] for i in passages.least_cover(np.array([a for a, _ in spans]), np.array([z for _, z in spans]))]
    cells = lambda s: {i for a, z in s for i in range(a, z)}
    assert cells(kept) == cells(spans) and all(sum(a <= i < z for a, z in kept) <= 2 for i in cells(spans))


def test_passages_of_words_said_over_and_over(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    turns = lambda n: ["to", "fro"] * n
    rows = [(i, " ".join(fresh(30) + turns(60 + 7 * i) + fresh(30))) for i in range(12)]
    found = Counter()
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["begin"] <= 32 or r["end"] >= 28 + 2 * (60 + 7 * r["doc_id"])
        found[r["doc_id"]] += 1
    assert set(found) == set(range(1, 12)) and max(found.values()) <= 3


def test_a_passage_of_many_documents_of_one_step(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    whole = fresh(60)
    rows = [(i, " ".join(fresh(10 + i % 7) + whole + fresh(8))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in passages.passages(docs).collect()}
    assert set(found) == set(range(1, 400))
    assert all(r["source_id"] < i and (r["begin"], r["end"]) == (10 + i % 7, 70 + i % 7) for i, r in found.items())


def test_alignment_goes_on_as_far_as_the_texts_agree(spark):
    rng = random.Random(14)
    fresh = lambda n: [f"u{rng.randint(0, 10**7)}" for _ in range(n)]
    whole = fresh(3000)
    # all keys but a few in the middle belong to smaller documents that hold 15 words each
    rows = [(i, " ".join(fresh(5) + whole[5 * i : 5 * i + 15] + fresh(5))) for i in range(600) if not 290 < i < 310]
    rows += [(1000, " ".join(whole)), (1001, " ".join(fresh(9) + whole))]
    found = [r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string"), passages.PassageRules(window=10**6, long=3000)).collect() if r["doc_id"] == 1001]
    assert [(r["source_id"], r["begin"], r["end"]) for r in found] == [(1000, 9, 3009)]
