"""Near-duplicates, packing, repeats, classifiers, scores, neighbours and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, ctw, neighbours, packing, quality, scoring, simhash, substring_dedup, toxicity


def pdf(spark, sf, table="documents"):
    return spark.read.parquet(f"{sf}/{table}.parquet").toPandas()


def brute_prints(texts):
    import xxhash

    out = []
    for t in texts:
        h = [xxhash.xxh64_intdigest(s, 42) for s in simhash.shingles(t)]
        out.append(sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0)
    return out


def brute_components(ids, prints, radius=4):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in zip(ids, prints, strict=True):
        for j, b in zip(ids, prints, strict=True):
            if (a ^ b).bit_count() <= radius and (p := top(i)) != (q := top(j)):
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_simhash_against_brute_force(spark, sf):
    rows = pdf(spark, sf)
    prints = brute_prints(rows.text)
    want = brute_components(rows.doc_id.tolist(), prints)
    got = {r.doc_id: r for r in simhash.op2_simhash(spark, sf).collect()}
    assert all(got[i].fingerprint == f"{p:016x}" for i, p in zip(rows.doc_id, prints, strict=True))
    assert {i: r.component_id for i, r in got.items()} == want


def test_split_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 9)), replace=False)) for _ in range(150)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for shard in (10, 2048):
        roots = {r.node: r.root for r in components.components(simhash.links(df, shard=shard)).collect()}
        want = brute_components(signed, [f % (1 << 64) for f in signed])
        groups = defaultdict(set)
        for f in signed:
            groups[roots.get(f, f)].add(f)
        expected = defaultdict(set)
        for f, w in want.items():
            expected[w].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("n", [0, 3, 600, 40_000, 1 << 24, 1 << 40])
def test_near_fingerprints_share_a_shard(spark, n):
    rng = np.random.default_rng(n % 1000)
    pairs = []
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        pairs.append((a, a ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))))
    signed = [tuple(f - (1 << 64) if f >= 1 << 63 else f for f in p) for p in pairs]
    df = spark.createDataFrame(signed, "a long, b long")
    keys = [simhash._shards(df[c], 4, n, 512) for c in "ab"]
    assert df.where(F.arrays_overlap(*keys)).count() == len(pairs)


def test_tree_follows_only_edges_within_the_radius():
    rng = np.random.default_rng(5)
    values = list({int(x) for x in rng.integers(0, 1 << 20, 2000)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for x in rng.integers(0, 1 << 20, 50).tolist():
        assert sorted(tree.near(x, 3)) == sorted(v for v in values if (v ^ x).bit_count() <= 3)


@pytest.mark.parametrize("right", [False, True])
def test_forest_connects_what_is_near(right):
    rng = np.random.default_rng(6)
    nodes = [(i, int(x)) for i, x in enumerate(rng.integers(0, 1 << 9, 160))]
    one, two = (nodes[:80], nodes[80:]) if right else (nodes, None)
    made = simhash.forest(one, two, 1)
    up = brute_components([i for i, _ in nodes], [x for _, x in nodes], 1)
    near = [(a, b) for a, x in one for b, y in (two or one) if a != b and (x ^ y).bit_count() <= 1]
    assert len(made) < len(nodes) and all((dict(nodes)[a] ^ dict(nodes)[b]).bit_count() <= 1 for a, b in made)
    group = {i: i for i, _ in nodes}
    for a, b in made:
        old, new = group[a], group[b]
        group = {i: new if g == old else g for i, g in group.items()}
    assert all(group[a] == group[b] for a, b in near) and all(up[a] == up[b] for a, b in made)


def test_similar_sets_in_parts():
    from tessera.llm import jaccard

    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 60, 40)
    sets = [np.unique(np.append(rng.choice(base, int(rng.integers(30, 41)), replace=False), rng.integers(0, 1 << 60, 2))).astype(np.uint64) for _ in range(60)]
    near = {(i, j) for i in range(60) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}

    def classes(pairs):
        up = list(range(60))
        for a, b in pairs:
            old, new = up[a], up[b]
            up = [new if g == old else g for g in up]
        return sorted(sorted(i for i in range(60) if up[i] == g) for g in set(up))

    whole = jaccard.similar(sets, None, 0.8)
    parts = jaccard.similar(sets[:25], None, 0.8) + [(a + 25, b + 25) for a, b in jaccard.similar(sets[25:], None, 0.8)] + jaccard.similar(sets[:25], sets[25:], 0.8)
    assert set(whole) <= near and len(whole) < 60 < len(near)
    assert classes(whole) == classes(parts) == classes(near)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[101] == 100


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3: 3, 4: 3, 5: 3}
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3, 4, 5)) == [1, 3]
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near(none).count() == 0


def encoder():
    import public_tokenizers

    return packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(spark, sf):
    e = encoder()
    texts = ["", " ", "  a  b ", "a <|endoftext|> b", "<|endoftext|>", " a\n b \n c", "a  b 　c", "it's  'll don't 12 3,4", "\x1c a \x1d", "a " * 50, *pdf(spark, sf).text[:60]]
    for t, got in zip(texts, e(texts), strict=True):
        assert got == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, ids_of, length=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    for doc, ids in ids_of.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.start for r in parts] == [s for s, _ in packing.cut(len(ids), length)]
        assert all(r.ids == ids[r.start : r.start + r.length].tobytes() for r in parts)
    return len(by_seq), sum(map(len, ids_of.values()))


def test_packing(spark, sf):
    rows, e = pdf(spark, sf), encoder()
    ids = {i: np.array([*e.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in zip(rows.doc_id, rows.text, strict=True)}
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    n, total = check_packing(got, ids)
    assert n <= 1.05 * total / 2048 + 2


def test_bins_are_bounded():
    b, used = packing.Bins(100, 4), Counter()
    rng = np.random.default_rng(0)
    for n in rng.integers(1, 101, 3000).tolist():
        number, offset = b.place(n)
        assert used[number] == offset and offset + n <= 100 and b.open <= 4
        used[number] += n
    assert len(used) <= 1.35 * sum(used.values()) / 100


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert {r.doc_id: r.length for r in rows if r.doc_id in (3, 4)} == {3: 1, 4: 1}
    assert sum(r.doc_id == 2 for r in rows) == 2
    assert packing.pack(none).count() == 0


def brute_repeats(rows, span=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            first.setdefault(b[p : p + span], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if first[b[p : p + span]] < i:
                gone[p : p + span] = True
        out[i] = (int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize(("batch", "hot"), [(400_000, 500_000), (2000, 500_000), (2000, 20), (2000, 0)])
def test_repeats_against_brute_force(spark, sf, monkeypatch, batch, hot):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    extra = [(10001, "a" * 300), (10002, None), (10003, "a" * 120 + "b" * 60), (10004, "ab" * 100), (10005, "x" * 49), (10006, "ab" * 90 + "é" * 60)]
    rows = [*pdf(spark, sf)[["doc_id", "text"]].itertuples(index=False, name=None), *extra]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    for i, (removed, spans, kept) in brute_repeats(rows).items():
        assert (got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) == (removed, spans, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_family_of_levels(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SCAN", 7)
    family, seen, rng = substring_dedup.Family(5), {}, np.random.default_rng(2)
    for doc in range(60):
        text = rng.choice(np.frombuffer(b"abc", np.uint8), 80).tobytes()
        at = np.arange(76)
        got = family.add(text, at, np.full(76, doc))
        for p in at.tolist():
            seen.setdefault(text[p : p + 5], doc)
        assert got.tolist() == [seen[text[p : p + 5]] for p in at.tolist()]
        for level in family.levels:
            strings = [level.text[p : p + 5] for p in level.at.tolist()]
            assert strings == sorted(set(strings))
    sizes = [len(x.at) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 8


def test_repeats_odd_rows(odd, none):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert got[3].n_bytes == got[4].n_bytes == 0 and got[1].n_removed == got[2].n_removed == 0
    assert substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifier_on_held_out_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    score = quality.score_quality if name == "quality" else toxicity.score_toxicity
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y, s = rows[name].to_numpy(), rows["score"].to_numpy()
    better = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert better > 0.85
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in rows.doc_id)


def test_classifiers_odd_rows(spark, odd, none, labels):
    for score in (quality.score_quality, toxicity.score_toxicity):
        rows = score(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert score(none, labels).count() == 0
        assert score(odd, labels.limit(0)).count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_best_threshold_against_all():
    rng = np.random.default_rng(12)
    for _ in range(20):
        score, y, weight = rng.integers(0, 12, 40) / 12, rng.integers(0, 2, 40), rng.random(40)
        y[:2] = 0, 1

        def f1(t, score=score, y=y, weight=weight):
            hit = score >= t
            return 2 * weight[hit & (y == 1)].sum() / (weight[hit].sum() + weight[y == 1].sum())

        got = toxicity.best_threshold(score, y, weight)
        assert f1(got) == pytest.approx(max(f1(t) for t in score))
    assert toxicity.best_threshold(np.ones(3), np.ones(3, int), np.ones(3)) == 0.5


def test_flags_by_language(spark):
    rng = np.random.default_rng(13)
    good = {"en": ["calm", "river", "stone"], "de": ["haus", "baum", "weg"]}
    rows, marks = [], []
    for i in range(400):
        lang = ("en", "de", None)[i % 3]
        words = list(rng.choice(good[lang or "en"], 12))
        if i % 4 == 0:
            words[int(rng.integers(12))] = "vile"
        rows.append((i, " ".join(words), lang, "x"))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (401, None, "fr", "x"), (402, "calm vile", "", "x")], "doc_id long, text string, lang string, threshold string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.flag_toxic(docs, labels).collect()}
    assert len(got) == 402 and got[401].threshold == 0.5 and got[402].threshold == got[2].threshold
    assert all(got[i].flagged == (got[i].score >= got[i].threshold) for i in got)
    assert np.mean([got[i].flagged == bool(t) for i, t in marks]) > 0.95
    bare = toxicity.flag_toxic(docs.drop("lang"), labels).collect()
    assert {r.threshold for r in bare} == {0.5} and {r.doc_id: r.score for r in bare} == pytest.approx({i: r.score for i, r in got.items()})
    # what the held-out fold's labels say changes nothing
    other = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: (r.score, r.threshold) for r in toxicity.flag_toxic(docs, other).collect()}
    assert again == {i: (r.score, r.threshold) for i, r in got.items()}


def test_thresholds_count_every_label(spark, monkeypatch):
    """Labels beyond the sample of the network have a part in the thresholds."""
    from tessera.llm import learn

    rows = [(i, "en", 0.3 if i % 4 == 0 else 0.1) for i in range(400)] + [(1000 + i, "de", 0.9 if i % 2 else 0.7) for i in range(100)] + [(2000, None, 0.2)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, other double")
    of = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1000 + i, int(i % 2)) for i in range(100)] + [(2000, 1)], "doc_id long, y int")
    out = spark.createDataFrame([(1, 1)], "doc_id long, k int").select("doc_id")
    got = {r["group"]: r.threshold for r in toxicity.language_thresholds(scored, of, out).collect()}
    assert got == {"en": pytest.approx(0.2), "de": pytest.approx(0.8), "": 0.5}
    for lang, at in (("en", 0), ("de", 1000)):
        keep = [(r[2], y[1]) for r, y in zip(rows, of.collect(), strict=True) if r[1] == lang and r[0] != 1]
        score, y = np.array(keep).T
        assert got[lang] == pytest.approx(toxicity.best_threshold(score, y.astype(int), np.ones(len(y))))
    seen = []
    real = toxicity.language_thresholds
    monkeypatch.setattr(toxicity, "language_thresholds", lambda s, o, f: seen.append(s.join(o, "doc_id").join(f, "doc_id", "left_anti").count()) or real(s, o, f))
    monkeypatch.setattr(learn.labelled_sample, "__defaults__", (0, 20, learn.LONGEST))
    docs = spark.createDataFrame([(i, "calm vile" if i % 4 == 0 else "calm river", "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    toxicity.flag_toxic(docs, labels).collect()
    training = docs.where(toxicity.fold_of(F.col("doc_id")) != 0).count()
    assert seen == [training - 32], "all training labels but the 32 of 40 that the network was fitted on"


def test_network_against_loops():
    """Scores of the network, computed once more word by word."""
    net = toxicity.Network()
    texts = ["a calm river runs", "", "Stone; stone!", "\u00c9t\u00e9 caf\u00e9 " * 30]
    for t, got in zip(texts, net.scores(texts), strict=True):
        words = [toxicity.buckets(w) for w in t.encode().lower().split()] + [(0,) * 5] * max(toxicity.WIDTHS)
        vectors = [sum(net.table[b] for b in w) for w in words]
        top = []
        for k, conv in zip(toxicity.WIDTHS, net.conv, strict=True):
            for f in range(toxicity.FILTERS):
                top.append(max(0.0, *(sum(float(vectors[i + j] @ conv[j][:, f]) for j in range(k)) for i in range(len(words) - k + 1))))
        assert got == pytest.approx(1 / (1 + math.exp(-float(np.dot(top, net.out) + net.bias))), rel=1e-4)


def test_compression_features_by_hand():
    """The features of a text, computed once more with compressors made anew for each chunk."""
    import zstandard

    good, bad = b"a fine and quiet morning in the valley " * 200, b"xkqz 99 !! zzzz click here now " * 200
    pairs = [(good[:4000], bad[:4000]), (good[:4000].translate(quality.SHAPE), bad[:4000].translate(quality.SHAPE))]
    text = (b"A quiet morning, 1999. " * 120)[:2500]

    def size(raw, dictionary=None):
        c = zstandard.ZstdCompressor(quality.LEVEL, dict_data=dictionary and zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(raw))

    got = quality.Compressors(pairs)(text)
    for at, (view, (g, b)) in enumerate(zip((text, text.translate(quality.SHAPE)), pairs, strict=True)):
        parts = [view[i : i + quality.CHUNK] for i in range(0, len(view), quality.CHUNK)]
        sums = [sum(size(p, d) for p in parts) for d in (g, b, None)]
        assert got[at] == pytest.approx((sums[1] - sums[0]) / sums[2])
    ratio = size(text) / (len(text) + 30)
    assert got[2:] == pytest.approx([ratio, math.log(ratio + 0.01), math.log(len(text) + 1)])
    assert quality.Compressors(pairs)(b"")[:2] == [0, 0]


def test_context_trees_sum_to_one():
    rng = np.random.default_rng(3)
    raw = rng.choice(np.frombuffer(b"abac abad\n", np.uint8), 3000)
    codes, counts = np.unique(ctw.codes_of(raw, 3), return_counts=True)
    trees = ctw.Trees(codes, counts.astype(np.int64), 3)
    for context in (b"\n\n\n", b"aba", b"zzz"):
        start = ctw.codes_of(np.frombuffer(context + b"\0", np.uint8), 3)[-1]
        total = (10 ** trees.log10(start + np.arange(256, dtype=np.uint64))).sum()
        assert total == pytest.approx(1)


def test_one_node_is_the_kt_estimate():
    trees = ctw.Trees(np.array([ord("a")], np.uint64), np.array([4]), 0)
    assert trees.log10(np.array([ord("a")], np.uint64))[0] == pytest.approx(8 * math.log10(4.5 / 5))


def recursive_log10(texts, depth):
    """Context-tree weighting from its definition, on dictionaries: a function from a text to its log10 probability."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(raw):
        for i, byte in enumerate(raw):
            past = (b"\n" * depth + raw[:i])[::-1][:depth]  # latest byte first
            for bit in range(8):
                yield past, (bit, byte >> (8 - bit)), byte >> (7 - bit) & 1

    for raw in texts:
        for past, node, one in decisions(raw):
            for d in range(depth + 1):
                counts[past[:d], node][one] += 1
                if d:
                    children[past[: d - 1], node].add((past[:d], node))

    def log_pe(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def log_pw(key):
        if key not in known:
            if len(key[0]) == depth:
                known[key] = log_pe(key)
            else:
                own, below = log_pe(key), sum(map(log_pw, children[key]))
                high = max(own, below)
                known[key] = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
        return known[key]

    def p(past, node, one, d):
        key = past[:d], node
        a, b = counts[key]
        kt = ((b if one else a) + 0.5) / (a + b + 1)
        if d == depth or (past[: d + 1], node) not in counts:
            return kt
        ratio = sum(map(log_pw, children[key])) - log_pe(key)
        stop = 1 / (1 + math.exp(min(ratio, 700)))
        return stop * kt + (1 - stop) * p(past, node, one, d + 1)

    def score(raw):
        return sum(math.log10(p(past, node, one, 0) if (b"", node) in counts else 0.5) for past, node, one in decisions(raw))

    return score


def test_scores_against_the_definition(spark):
    words = ["the", "cat", "sat", "on", "mat", "Dog", "caf\u00e9", "123"]
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 12))))) for i in range(60)] + [(60, None), (61, "zebra \u4e2d"), (None, "the cat")]
    train = [scoring.canonical(t or "")[1] for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    for depth in (2, 3, ctw.DEPTH):
        want = recursive_log10(train, depth)
        got = {r.doc_id: r.score for r in scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            assert got[i] == pytest.approx(want(scoring.canonical(t or "")[1]), rel=1e-9)


def test_scores_against_brute_force(spark, sf):
    rows = pdf(spark, sf)
    words, codes = Counter(), []
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w, b = scoring.canonical(t)
            words.update([*w, scoring.END])
            codes.append(ctw.codes_of(np.frombuffer(b, np.uint8)))
    n, v = sum(words.values()), len(words)
    k, c = np.unique(np.concatenate(codes), return_counts=True)
    trees = ctw.Trees(k, c.astype(np.int64))
    got = {r.doc_id: r for r in scoring.op6_score(spark, sf).collect()}
    for i, t in list(zip(rows.doc_id, rows.text, strict=True))[:80]:
        w, b = scoring.canonical(t)
        w = [*w, scoring.END]
        base = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(words[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(base)
        assert got[i].score == pytest.approx(trees.log10(ctw.codes_of(np.frombuffer(b, np.uint8))).sum(), rel=1e-9, abs=1e-9)


def test_scores_odd_rows(odd, none):
    rows = scoring.score_texts(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert scoring.score_texts(none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 16)), np.repeat(rng.normal(size=(1, 16)), 40, axis=0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, 50).toPandas()
    norm, hits, n = np.linalg.norm(x, axis=1), 0, 0
    for q, part in got.groupby("query_id"):
        s = x @ x[q] / (norm * norm[q])
        s[q] = -9
        part = part.sort_values("rank")
        assert np.allclose(part.score, s[part.vec_id], atol=1e-12)
        hits += len(set(np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:5]) & set(part.vec_id))
        n += 5
    assert sorted(got.query_id.unique()) == list(range(0, 740, 50)) and hits >= 0.9 * n


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in neighbours.nearest(df, 50).orderBy("rank").collect()] == [1, 2]
    assert neighbours.nearest(df.limit(0), 50).count() == 0
    assert neighbours.nearest(df.limit(1), 50).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    assert [k for k, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for _, f in p.STAGES[:-1]:
        docs = spark.createDataFrame(seen[-1])
        out = f(spark, docs, sf)
        assert out.columns == columns
        seen.append(out.toPandas())
    good, exact, near, mixed = seen[1:]
    assert len(good) < len(seen[0]) and exact.text.is_unique and set(exact.text) == set(good.text)
    assert set(near.doc_id) == brute_similar(list(zip(exact.doc_id, exact.text, strict=True)))
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.doc_id.value_counts().max() <= 3
    rows = p.packed(spark, spark.createDataFrame(mixed), sf).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    assert (rows[rows.start == 0].groupby("doc_id").size() == pd.Series(mixed.doc_id).value_counts().sort_index()).all()


def brute_similar(rows):
    """The ids that stay: the smallest of each component of pairs with a Jaccard similarity of 0.8 or more."""
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, set(simhash.shingles(t, 5))) for i, t in rows]
    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if (not a and not b or 5 * len(a & b) >= 4 * len(a | b) > 0) and (p := top(i)) != (q := top(j)):
                up[max(p, q)] = min(p, q)
    return {top(i) for i in up}


@pytest.mark.parametrize("part", [400_000, 3000])
def test_drop_near_against_brute_force_jaccard(spark, sf, part):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):  # families on both sides of the similarity, and chains
        text = list(rng.choice(words, 150))
        for n in range(6):
            rows.append(" ".join(text))
            text = list(text)
            for at in rng.choice(150, rng.integers(1, 6), replace=False):
                text[at] = str(rng.choice(words))
    rows = list(enumerate(rows)) + [(1000 + r.doc_id, r.text) for r in pdf(spark, sf).itertuples()]
    want = brute_similar(rows)
    got = [r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()]
    assert len(got) == len(want) and set(got) == want and 40 < len([i for i in want if i < 1000]) < 240


@pytest.mark.parametrize("noise", [0.003, 0.001])
def test_neighbours_inside_a_cluster(spark, noise):
    rng = np.random.default_rng(9)
    x = rng.normal(size=64) + noise * rng.normal(size=(1500, 64))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, 100).toPandas()
    y, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q, part in got.groupby("query_id"):
        far = ((y - y[q]) ** 2).sum(1)
        far[q] = 9
        hits += len(set(np.argsort(far)[:5]) & set(part.vec_id))
    print("recall", hits / 75)
    assert hits >= 0.9 * 75


def test_exact_neighbours_and_odd_vectors(spark):
    """Nulls, repeated ids, huge and tiny components, clashing names; the graph against the exact way."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in r], i, "q") for i, r in enumerate(x)]
    rows += [(500, [1e308] * 8, 0, "q"), (501, [1e308] * 7 + [-1e308], 0, "q"), (550, [1e-308] * 8, 0, None), (0, [float(v) for v in x[0]], 0, "q")]
    rows += [(600, None, None, None), (650, [None] + [1.0] * 7, 0, ""), (None, [1.0] * 8, 0, ""), (700, [float("inf")] * 8, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, hash string")
    want = {(r.query_id, r.rank): r for r in neighbours.nearest_exact(df, 50, block=3).collect()}
    assert {q for q, _ in want} == {0, 50, 100, 150, 200, 250, 500, 550} and len(want) == 40
    ids = np.array([*range(300), 500, 501, 550])
    y = np.concatenate([x, np.ones((3, 8))])
    y[-2, -1] = -1
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for q in (0, 50, 100, 150, 200, 250, 500, 550):
        sims = np.round(y @ y[np.flatnonzero(ids == q)[0]], 12)
        sims[ids == q] = -9
        order = np.lexsort((ids, -sims))[:5]
        assert [want[q, k].vec_id for k in range(1, 6)] == ids[order].tolist()
        assert [want[q, k].score for k in range(1, 6)] == pytest.approx(sims[order].tolist())
    got = {(r.query_id, r.rank): r for r in neighbours.nearest(df, 50).collect()}
    assert got.keys() == want.keys() and all(math.isfinite(r.score) for r in got.values())
    same = sum(got[k].vec_id == want[k].vec_id for k in want)
    assert same >= 36 and all(got[k].score == want[k].score for k in want if got[k].vec_id == want[k].vec_id)
    assert neighbours.nearest_exact(df.limit(0), 50).count() == 0


def test_pipeline_odd_rows(spark, odd, none, labels, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows, clashing names and an empty table."""
    import corpus_pipeline as p

    for name, frame in (("documents", odd), ("labels", labels)):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = odd
    for name, f in p.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert f(spark, none, str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == odd.columns
        if name == "quality":  # the labels are too few for the classifier: all scores are the share of label 1
            assert out.count() == odd.count()
        if name == "exact_dedup":
            assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 4, 5, 7, 8]
        if name == "near_dedup":
            assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 4, 7, 8]
        if name == "packing":
            rows = out.toPandas()
            assert rows.groupby("sequence_id").length.sum().max() <= 2048 and (rows.piece >= 0).all()
        else:
            docs = spark.createDataFrame(out.collect(), odd.schema)
    whole = p.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
