"""Training-data operators against plain Python, with nulls, empty and repeated texts, and empty tables."""

import collections
import hashlib
import json
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from docketlake.llm import binaryfuse, common, decontamination, exact_dedup, jaccard_join, lm_scoring, packing, quality, sharding, substring_dedup, surrogates, warc
from docketlake.llm.common import components
from docketlake.llm.fmindex import FMIndex

KEY = b"key of the tests"
BLANK = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, row int"


def split(text):
    return [w for w in BLANK.split(text or "") if w]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    line = " ".join(r.choice(vocabulary) for _ in range(30))
    out = [None, "", "  ", "one two", "One  two", "one two three four five", "x" * 3000]
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        out.append(" ".join(words))
        if r.random() < 0.5:
            out.append("\t".join(words))
        if r.random() < 0.5:
            near = list(words)
            near[r.randrange(len(near))] = "changed"
            out.append(" ".join(near))
        if r.random() < 0.3:
            out.append(" ".join(words[:10]) + " " + line + " " + " ".join(words[10:]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", "en", None, 0, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000])
def test_filter_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    made = binaryfuse.build(keys)
    assert binaryfuse.contains(made, keys).all()
    assert binaryfuse.contains(made, np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.001


def test_exact_dedup(docs, texts, none):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[BLANK.sub(" ", t or "")].append(i)
    got = {r.doc_id: r for r in exact_dedup.mark_duplicates(docs, 8).collect()}
    for body, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(body.encode()).hexdigest())
    assert got[None].kept and exact_dedup.mark_duplicates(none, 8).count() == 0


def test_exact_dedup_of_one_id_with_two_texts(spark):
    rows = [(1, "copy text"), (5, "copy  text"), (5, "only here"), (9, "only here"), (None, "nobody"), (None, "nobody"), (None, "copy text"), (7, None), (7, ""), (8, " "), (8, "\t")]
    extra = spark.createDataFrame([(*r, i, "x", True) for i, r in enumerate(rows)], "doc_id long, text string, tag int, keep_id string, arrives boolean")
    got = [(r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(extra, 3).collect()]
    want = sorted([(1, 1, 3, True), (5, 1, 3, False), (0, 1, 3, False), (5, 5, 2, True), (9, 5, 2, False), (0, None, 2, True), (0, None, 2, True), (7, 7, 2, True), (7, 7, 2, True), (8, 8, 2, True), (8, 8, 2, True)], key=str)
    assert sorted(got, key=str) == want
    kept = exact_dedup.keep_first(extra)
    assert kept.columns == extra.columns
    assert sorted((r.doc_id or 0, BLANK.sub(" ", r.text or "")) for r in kept.collect()) == [(0, "nobody"), (1, "copy text"), (5, "only here"), (7, ""), (8, " ")]


def test_sharding(docs, texts, none):
    rows = sharding.shard_documents(docs, 5).collect()
    slots = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id] or "" if r.doc_id is not None else "no id"].add(r.shard)
    assert len(rows) == len(texts) + 1 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(none, 5).count() == 0


def test_sharding_and_packing_with_clashing_columns(spark):
    rows = [(i % 7 if i % 5 else None, ["same text", None, "", "word " * 200_000][i % 4]) for i in range(40)]
    frame = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, size int, digest int, shard string, n_tokens int")
    got = sharding.shard_documents(frame, 3).collect()
    assert sorted(r["size"] for r in got) == sorted(len(t or "") + 8 for _, t in rows) and all(r.text_crc32 >= 0 and r.grown_shard is None for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(3) for k in range(sum(r.shard == s for r in got))]
    packed = packing.pack(frame, 1000, 3).collect()
    assert sorted(r.n_tokens for r in packed) == sorted(len((t or "").split()) for _, t in rows)
    long = [(r.bucket, r.batch) for r in packed if r.n_tokens > 1000]
    assert len(set(long)) == len(long) == 10


def test_scratch_tables_are_removed(spark, tmp_path):
    made = common.written(spark.range(3), "kept")
    folder = common._scratch[-1]
    common.drop_scratch(spark)
    assert not common._scratch and not os.path.exists(folder) and made is not None


def test_differencing_is_balanced():
    loads = np.zeros((400, 7), np.int64)
    loads[:, 0] = np.random.default_rng(3).integers(1, 5000, 400)
    place, final = sharding.difference(loads)
    assert np.bincount(place[:, 0], weights=loads[:, 0], minlength=7).tolist() == final.tolist() and final.max() - final.min() <= 2


@pytest.mark.parametrize("large", [[0.03], [0.03, 0.02, 0.02, 0.011], [0.3]])
def test_sharding_fills_up_beside_large_groups(spark, large):
    sizes = np.random.default_rng(7).integers(100, 5000, 5000).tolist()
    rest = sum(sizes)
    sizes += [int(x * rest / (1 - sum(large))) for x in large]
    rows = spark.createDataFrame([(f"k{i}", n) for i, n in enumerate(sizes)], "key string, size long")
    got = {r.key: r.shard for r in sharding.assign_groups(rows, "key", 24, chunk=1000).collect()}
    assert sorted(got) == sorted(f"k{i}" for i in range(len(sizes)))
    loads = np.bincount([got[f"k{i}"] for i in range(len(sizes))], weights=sizes, minlength=24)
    assert loads.max() <= 1.002 * max(loads.mean(), max(sizes))


def test_language_model(docs, texts, none):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [[*split((t or "").translate(low)), "END"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, scale = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, 2).collect()}
    assert len(got) == len(rows)
    for (i, _), ws, h in zip(rows, words, held):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(ws), sum(w in counts for w in ws), total)
        assert abs(r.base_score - sum(math.log10(counts[w] + 1) - scale for w in ws)) < 1e-6 and r.score < 0
    seen = [got[i] for (i, _), h in zip(rows, held) if not h]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)  # it has learned
    assert lm_scoring.score_documents(none, 2).count() == 0


def test_language_model_without_training_documents_and_with_clashing_columns(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "a b c " * (i + 1), 1, "x", b"y", 2) for i in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row int, block string, keys binary, shard int")
    got = lm_scoring.score_documents(frame, 2).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 4 and all(r.held_out for r in got)
    named = frame.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in lm_scoring.score_documents(named, 1).collect()} == {f"d{i}" for i in ids}


def test_word_probabilities_sum_to_one():
    r = np.random.default_rng(6)
    words = np.sort(r.integers(1, 1 << 62, 400).astype(np.uint64))
    counts, singles = r.integers(1, 50, 400), words[:3]
    kinds = lm_scoring.word_class(words, singles)
    k = lm_scoring.CLASSES
    total, distinct = np.bincount(kinds, weights=counts, minlength=k), np.bincount(kinds, minlength=k).astype(float)
    model = lm_scoring.Model(1, 1, words, counts, singles, total, distinct, np.zeros(k), np.zeros((1, k)))
    kind = int(kinds[10])
    inside = np.flatnonzero(kinds == kind)
    number = np.concatenate([[0], inside + 1])
    key = (np.uint64(77) << np.uint64(26)) | ((np.full(len(number), kind) << 20) | number).astype(np.uint64)
    n = np.where(r.random(len(key)) < 0.4, r.integers(1, 90, len(key)), 0)
    found = lm_scoring.pair_weights(model, key, n)
    share = model.word_share(inside, np.full(len(inside), kind))
    assert abs((share * np.exp(found[1:])).sum() + (1 - share.sum()) * np.exp(found[0]) - 1) < 1e-9
    # the likelihood of the counts is better than by frequency alone, and close to its penalised optimum
    assert (n * found).sum() > 0 and np.allclose(found, lm_scoring.pair_weights(model, key, n, steps=60), atol=0.05)
    unpacked = [lm_scoring.unpack_keys(lm_scoring.pack_keys(x), len(x)) for x in (key, np.sort(r.integers(0, 1 << 63, 50).astype(np.uint64)), key[:1])]
    assert (unpacked[0] == key).all() and (np.diff(unpacked[1].astype(float)) >= 0).all() and (unpacked[2] == key[:1]).all()


def test_class_probabilities_sum_to_one():
    weights = np.random.default_rng(1).normal(size=(1 << lm_scoring.FEATURE_BITS, lm_scoring.CLASSES)).astype(np.float32)
    empty = np.zeros(0, np.uint64)
    model = lm_scoring.Model(1, 1, empty, empty, empty, np.ones(1), np.ones(1), np.zeros(lm_scoring.CLASSES, np.float32), weights)
    feats = model.features(np.arange(50, dtype=np.uint64), np.array([0, 1, 20, 50]))
    assert np.allclose(np.exp(model.class_scores(feats)).sum(1), 1, atol=1e-4)


def test_decontamination(spark, docs, none):
    item = "a passage of the benchmark that is long enough to be found in any document that quotes it with a few edits here and there"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")
    rows = [(1, "before " + item.upper().replace(" ", "\n") + " after"), (2, item.replace("few", "fwe").replace("long", "lon")), (3, item[:50]), (4, None), (5, "x" * 500)]
    got = {r.doc_id: r.item_ids for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: [], 5: []}
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns and decontamination.contamination(none, bench).count() == 0


def test_a_long_quotation_contaminates_whatever_its_share(spark):
    r = random.Random(11)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(450))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = [(1, "before " + item[300:1300] + " after"), (2, "one " + item[805:985] + " two"), (3, "one " + item[805:895] + " two"), (4, "x" * 500)]
    got = {r.doc_id: r.item_ids for r in decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: []}


def test_decontamination_with_any_item_ids(spark):
    item = "a passage of the benchmark that is long enough to be found in any document that quotes it with a few edits here and there"
    for kind, ids in (("string", ["b", "a", None]), ("int", [5, 2, None])):
        bench = spark.createDataFrame([(i, item, "x") for i in ids], f"item_id {kind}, text string, seg string")
        rows = spark.createDataFrame([("d1", f"so {item}", 1), ("d2", "clean " * 50_000, 2), (None, None, 3)], "doc_id string, text string, item_ids int")
        got = {r.doc_id: r.item_ids for r in decontamination.contamination(rows, bench).collect()}
        assert got == {"d1": [ids[1], ids[0], None], "d2": [], None: []}
        assert [r.doc_id for r in decontamination.drop_contaminated(rows, bench).orderBy("doc_id").collect()] == [None, "d2"]
    assert not any(r.contaminated for r in decontamination.contamination(rows, bench.limit(0)).collect())


def test_decontamination_agrees_with_full_alignment():
    def folded(text):
        return re.sub(r"[^a-z0-9]+", " ", text.lower())

    def least_edits(piece, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(piece):
            now = [i + 1]
            for j, d in enumerate(text):
                now.append(min(row[j] + (c != d), row[j + 1] + 1, now[-1] + 1))
            row = now
        return min(row)

    def brute(text, item):
        body, mask = folded(item).strip(), set()
        last = max(0, len(body) - 80)
        for at in sorted({*range(0, last, 40), last}):
            piece = body[at : at + 80]
            edits = min(int(len(piece) * 0.08), max(0, (len(piece) - 10) // 10))
            if len(piece) >= 10 and least_edits(piece, folded(text)) <= edits:
                mask |= set(range(at, at + len(piece)))
        runs = "".join("x" if i in mask else " " for i in range(len(body))).split()
        return len(mask) >= 0.5 * len(body) or max(map(len, runs), default=0) >= 120

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 5)))
    common = " ".join(word() for _ in range(12))
    items = [" ".join([*(word() for _ in range(r.randint(2, 40))), common, *(word() for _ in range(r.randint(0, 40)))]) for _ in range(12)]
    texts = []
    for k in range(60):
        body = list(r.choice(items))
        for _ in range(r.choice([0, 1, 3, 6, 9, 14, 25])):
            i = r.randrange(len(body))
            body[i : i + r.randint(0, 1)] = r.choice(["", "z", "q"])
        body = body[: r.choice([len(body), len(body) // 2, 70])]
        texts.append(" ".join(word() for _ in range(r.randint(0, 15))) + " " + "".join(body) + " " + common.upper() + "!")
    index = decontamination.build_index(list(enumerate(items)))
    raw = [t.lower().encode() for t in texts]
    found = decontamination.find(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), index)
    want = {k: sorted(i for i, item in enumerate(items) if brute(t, item)) for k, t in enumerate(texts)}
    assert {k: sorted(i for i, _ in v) for k, v in found.items()} == {k: v for k, v in want.items() if v}
    assert 5 < sum(map(bool, want.values())) < 60


def test_jaccard_join(docs, texts, none):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = split((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b in range(a):
                if x and sets[b] and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        break
    for a in range(len(root)):
        while root[a] != root[root[a]]:
            root[a] = root[root[a]]
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), root[i]) for i, s in enumerate(sets)]
    assert got[None].component_id is None and jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_of_one_id_with_two_texts(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = [*base[:-1], "z"]
    rows = [(4, " ".join(base)), (4, " ".join(other)), (6, " ".join(near)), (6, "\t".join(near)), (8, " ".join(other)), (3, "x"), (3, "x"), (9, None), (9, ""), (None, " ".join(base)), (5, "q " * 300_000)]
    frame = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "doc_id long, text string, key int, tag long, node string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.near_duplicates(frame).collect())
    assert got == sorted([(4, 56, 4), (4, 56, 4), (6, 56, 4), (6, 56, 4), (8, 56, 4), (3, 1, 3), (3, 1, 3), (9, 0, 9), (9, 0, 9), (0, 56, 0), (5, 1, 5)])
    kept = jaccard_join.keep_one_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept.collect()) == sorted([(4, "w0 "), (4, "v0 "), (3, "x"), (9, ""), (9, ""), (0, "w0 "), (5, "q q")])


def test_divide_skip_is_exact():
    r = np.random.default_rng(2)
    query = np.unique(r.integers(0, 400, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([query[: r.integers(1, len(query) + 1)], r.integers(0, 400, r.integers(1, 60)).astype(np.uint64)])) for _ in range(80)]
    owner, key = np.repeat(np.arange(80), [len(s) for s in sets]), np.concatenate(sets)
    got = set(jaccard_join.divide_skip(query, np.array([len(s) for s in sets]), owner, key).tolist())
    want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 80 * len(np.union1d(s, query))}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 100), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 100}


def test_quality(spark, docs, none):
    good = [(i, "a calm and plain sentence about the river and the hills number " + " ".join(random.Random(i).choices(["oak", "elm", "fir", "ash"], k=30)), "en", "h", 0, "", 0) for i in range(200)]
    bad = [(1000 + i, "WIN!! " * 20 + "$$$ ### " * random.Random(i).randint(5, 20), "en", "h", 0, "", 0) for i in range(100)]
    rows = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000 + i, 0, 0) for i in range(0, 100, 2)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(rows, labels).collect()}
    held = [i for i in got if i % 2]
    assert np.mean([got[i] == (i < 1000) for i in held]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.classify(docs, empty).collect()) and quality.classify(none, labels).count() == 0


def test_quality_posteriors_in_plain_python(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["oak", "elm", "WIN!!", "$$$", "the", "calm"]) for _ in range(r.randint(1, 40))), r.choice(["en", "de", None]), r.choice(["h1", "h1", "h1", "h2", "h3", None]), 0, "", 0) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "no id", "en", "h1", 0, "", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, int("WIN!!" not in rows[i][1]), 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    site = {i: (h or "", p or "") for i, _, p, h, *_ in rows} | {None: ("h1", "en")}
    sums = collections.defaultdict(lambda: [0.0, 0])
    for x in got:
        for key in ((), site[x.doc_id][:1], site[x.doc_id]):
            sums[key][0] += x.p_document
            sums[key][1] += 1
    overall = min(max(sums[()][0] / sums[()][1], 1e-4), 1 - 1e-4)

    def strength(keys, prior):
        n = sum(sums[k][1] for k in keys)
        between = sum(sums[k][1] * (sums[k][0] / sums[k][1] - prior(k)) ** 2 for k in keys)
        within = sum(sums[k][1] * prior(k) * (1 - prior(k)) for k in keys)
        return min(1e4, max(2.0, within / n / max(between / n - within / n * len(keys) / n, 1e-6)))

    hosts, paths = [k for k in sums if len(k) == 1], [k for k in sums if len(k) == 2]
    kh = strength(hosts, lambda k: overall)
    p_host = {k: (sums[k][0] + kh * overall) / (sums[k][1] + kh) for k in hosts}
    kp = strength(paths, lambda k: p_host[k[:1]])
    p_path = {k: (sums[k][0] + kp * p_host[k[:1]]) / (sums[k][1] + kp) for k in paths}
    logit = lambda p: math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    for x in got:
        odds = logit(x.p_document) + logit(p_path[site[x.doc_id]]) - logit(overall)
        assert abs(x.p_host - p_host[site[x.doc_id][:1]]) < 1e-9 and abs(x.p_path - p_path[site[x.doc_id]]) < 1e-9
        assert abs(x.p_good - 1 / (1 + math.exp(-odds))) < 1e-9 and x.kept == (x.p_good >= 0.5)


def test_quality_rejects_rows_not_ids(spark):
    good, bad = "a calm and plain sentence about the river and the hills ", "WIN!! $$$ ### " * 12
    rows = [(i, good * 2 + str(i), "en", "h", 0, "", 0) for i in range(120)] + [(500 + i, bad + str(i), "en", "h", 0, "", 0) for i in range(60)]
    rows += [(900, bad, "en", "h", 0, "", 0), (900, good * 2, "en", "h", 0, "", 0), (None, bad, "en", "h", 0, "", 0), (901, "", "en", "h", 0, "", 0)]
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i, *_ in rows if i is not None and i < 900], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_good(docs, labels)
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and (900, good * 2) in left and (900, bad) not in left and (None, bad) not in left and len({i for i, _ in left if i is not None and i < 500}) == 120


def test_packing(docs, texts, none):
    rows = packing.pack(docs, 300, 4).collect()
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_tokens
        batches[r.bucket, r.batch].append(r)
    assert len(rows) == len(texts) + 1
    for got in batches.values():
        assert sorted(r.place for r in got) == list(range(len(got))) and (len(got) == 1 or sum(r.padded_tokens for r in got) <= 300)
    assert packing.pack(none).count() == 0


def test_boundaries_are_optimal():
    import itertools

    tops, counts = np.array([1, 4, 5, 9, 20, 33]), np.array([5, 1, 7, 2, 3, 1])

    def cost(ends):
        return sum(c * min(e - t for e in ends if e >= t) for t, c in zip(tops, counts))

    got = packing.boundaries(tops, counts, 3)
    assert cost(got) == min(cost(c) for c in itertools.combinations(tops, 3) if 33 in c)


def test_packing_pads_long_documents_to_real_lengths(spark):
    import itertools

    lengths = [5460, 5459, 5457, 600, 601, 603, 1999, 2001, 2003, 7]
    rows = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    got = packing.pack(rows, buckets=4).collect()
    best = min(sum(min(e for e in c if e >= n) for n in lengths) for c in itertools.combinations(sorted(lengths), 4) if 5460 in c)
    assert {r.padded_tokens for r in got} <= set(lengths) and sum(r.padded_tokens for r in got) == best
    assert len({r.batch for r in got if r.n_tokens > 5000}) == 1


def test_boundaries_agree_with_the_quadratic_program():
    r = np.random.default_rng(8)
    for _ in range(40):
        m, k = int(r.integers(1, 60)), int(r.integers(1, 9))
        tops, counts = np.sort(r.choice(np.arange(1, 3000), m, replace=False)), r.integers(1, 50, m)
        least = np.full(m + 1, np.inf)
        least[0] = 0
        for _ in range(k):
            least = np.array([0, *[min(least[j], min(least[i] + (tops[j - 1] - tops[i:j]) @ counts[i:j] for i in range(j))) for j in range(1, m + 1)]])
        ends = np.array(packing.boundaries(tops, counts, k))
        assert len(ends) <= k and (ends[np.searchsorted(ends, tops)] - tops) @ counts == least[m]


def test_surrogates(spark, docs, none):
    for n in (2, 3, 10, 97):
        moved = [surrogates._shift(x, n, b"key", b"t") for x in range(n)]
        assert sorted(moved) == list(range(n)) and all(a != b for a, b in enumerate(moved))
    text = "Dr. Maria Schmidt, a.b@c.example.com, +1 (017) 555-7713, again A.B@c.example.com and 10.2.3.4"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "call +1 (017) 555-7713 now")], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(rows, KEY).collect()}
    assert got[1].n_entities == 5 and not any(x in got[1].text for x in ("Maria", "a.b@", "555-7713", "10.2.3.4"))
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)[0]
    assert phone in got[4].text and got[2].text is None and got[3].text == ""
    mails = re.findall(r"\S+@[\w.]+\.com", got[1].text)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()
    assert surrogates.replace_entities(none, KEY).count() == 0


def test_surrogates_of_all_mentions_of_a_name(spark):
    text = "Schmidt wrote: é Dr. Maria Schmidt of Schmidtburg came. Then Maria Schmidt said so, SCHMIDT agreed, and Maria left; Schmidt@corp.example.com"
    rows = spark.createDataFrame([(1, text), (2, "Schmidt is not titled here")], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(rows, KEY).collect()}
    first, last = surrogates.surrogate("name", "Maria Schmidt", KEY).split(" ")
    mail = surrogates.surrogate("email", "Schmidt@corp.example.com", KEY)
    assert got[1].text == f"{last} wrote: é Dr. {first} {last} of Schmidtburg came. Then {first} {last} said so, {last.upper()} agreed, and {first} left; {mail}"
    assert got[1].n_entities == 6 and got[1].kinds == ["email", "name"] and (got[2].text, got[2].n_entities) == ("Schmidt is not titled here", 0)


def test_surrogates_in_other_scripts(spark):
    names = ["王小明", "محمد", "משה", "Łukasz", "ქართველი"]
    rows = spark.createDataFrame([(i, f"Dr. {n} came") for i, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(rows, KEY).collect()}
    for i, name in enumerate(names):
        new = re.fullmatch(r"Dr\. (\w+) came", got[i].text)[1]
        assert got[i].n_entities == 1 and new != name and len(new) == len(name)
    rows = spark.createDataFrame([(1, "they came"), (2, "Dr. Maria Schmidt"), (3, "и Г-н Иванов")], "doc_id long, text string").coalesce(1)
    assert [r.n_entities for r in surrogates.replace_entities(rows, KEY).orderBy("doc_id").collect()] == [0, 1, 1]
    chars = [chr(c) for c in range(0x4E00, 0x4E80)]
    assert len({surrogates.surrogate("name", a + b, KEY) for a in chars[:40] for b in chars[60:100]}) == 1600


def test_surrogates_of_long_texts_take_linear_time(spark):
    rows = [(1, "x1" * 500_000), (2, "a1." * 300_000), (3, "@" * 300_000), (4, "7, " * 300_000 + "mail j.doe@corp.example.com")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kinds string, n_entities int")
    began = time.time()
    got = {r.doc_id: r for r in surrogates.replace_entities(frame, KEY).collect()}
    assert time.time() - began < 60 and got[4].n_entities == 1 and [len(got[i].text) for i in (1, 2, 3, 4)] == [len(t) for _, t in rows]


def test_warc(spark):
    raw = warc.response("http://a.example/x", "<html><title>T &amp; t</title><script>var a</script><p>One<br>two</p><a href='/y'>link</a></html>")
    source, _ = warc.parse(raw)
    for made in warc.derive(raw):
        h, block = warc.parse(made)
        assert warc.first(h, "WARC-Refers-To") == warc.first(source, "warc-record-id") and warc.first(h, "WARC-Block-Digest") == warc.digest(block) and int(warc.first(h, "Content-Length")) == len(block)
    assert warc.parse(warc.derive(raw)[1])[1].decode() == "T & t\nOne\ntwo\nlink"
    pages = spark.createDataFrame([(1, None, None, 1, "x"), (2, "http://b.example", "<p>x", 2, "y"), (2, "http://b.example", "<p>x", 2, "y")], "page_id long, url string, html string, number int, record string")
    got = warc.derivatives(pages).collect()
    assert len(got) == 6 and len({r.record_id for r in got}) == 6 and warc.derivatives(pages.where("page_id > 9")).count() == 0
    named = {r.record_id: r for r in got}
    for r in named.values():
        h, block = warc.parse(bytes(r.record))
        assert (warc.first(h, "WARC-Record-ID"), warc.first(h, "WARC-Refers-To"), len(block)) == (r.record_id, r.refers_to, r.content_length)


def test_warc_keeps_all_headers():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie:b=2\r\nX-Long: one\r\n two\r\n\r\n<p>x"
    raw = warc.record("response", {"WARC-Record-ID": "<urn:x>", "WARC-Date": "d", "WARC-Target-URI": "u"}, http)
    meta = json.loads(warc.parse(warc.derive(raw)[0])[1])["Envelope"]["HTTP-Response-Metadata"]
    assert meta["Headers"] == {"Set-Cookie": ["a=1", "b=2"], "X-Long": "one two"}
    for broken in (b"", b"WARC/1.0\r\n\r\n", raw[:-30], b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(broken)


def test_warc_text_of_made_pages():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    for _ in range(200):
        page, lines, links = [], [], []
        for _ in range(r.randint(0, 8)):
            words = [word() for _ in range(r.randint(1, 5))]
            kind = r.randrange(5)
            if kind == 0:
                page.append(f"<script src='/{words[0]}.js'>{' '.join(words)} < 3</script>")
                continue
            if kind == 1:
                page.append(f"<!-- {' '.join(words)} <p> -->")
                continue
            if kind == 2:
                links.append(f"/{words[0]}?a=1&b=2")
                page.append(f'<div class="x"> <a href="/{words[0]}?a=1&amp;b=2">{" ".join(words)}</a>\t</div>')
            else:
                tag = r.choice(["p", "li", "h2", "td"])
                page.append(f"<{tag} id={words[0]}>\n{'  '.join(words)} &lt;&eacute; </{tag}>")
                words.append("<é")
            lines.append(" ".join(words))
        assert warc.plain_text("".join(page)).split("\n") == (lines or [""])
        meta = json.loads(warc.parse(warc.derive(warc.response("u", "".join(page)))[0])[1])
        assert [x["url"] for x in meta["Envelope"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Links"] if x["tag"] == "a"] == links


def test_warc_takes_linear_time():
    began = time.time()
    for page in ("<p " * 200_000, "<a href=" * 200_000, "<title " * 200_000, "<!--" * 200_000, "<script>" * 200_000, "<" * 500_000):
        warc.derive(warc.response("u", page))
    assert time.time() - began < 20


def test_fm_index():
    r = np.random.default_rng(4)
    sequences = [r.integers(0, 4, r.integers(1, 40)).astype(np.uint64) for _ in range(30)]
    owners = r.permutation(30)
    index = FMIndex(sequences[:20], owners[:20], 5)
    statistic, owner = index.matching(sequences)
    at = 0
    for s in sequences:
        for i in range(len(s)):
            want, least = 0, -1
            for d in range(1, min(5, len(s) - i) + 1):
                hits = [o for t, o in zip(sequences[:20], owners[:20]) if any((t[j : j + d] == s[i : i + d]).all() for j in range(len(t) - d + 1))]
                if not hits:
                    break
                want, least = d, min(hits) if d == 5 else -1
            assert (statistic[at + i], owner[at + i]) == (want, least)
        at += len(s)


def test_substring_dedup(docs, texts, none):
    first = {}
    words = [split(t) for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i, w in enumerate(words):
        drop = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                drop |= set(range(k, k + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in drop)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_one_id_with_two_texts(spark):
    r = random.Random(9)
    a, b, c = ([f"{p}{r.randrange(10**6)}" for _ in range(30)] for p in "abc")
    long = [f"l{i % 977}" for i in range(120_000)]
    rows = [(1, a), (2, a), (2, b), (2, b), (3, [*b[:15], *c]), (3, [*c, *b[:20]]), (4, a[:12]), (5, long), (6, long[50_000:]), (7, a)]
    frame = spark.createDataFrame([*((i, (" " if i % 2 else "\t").join(w), 1, "x", 5) for i, w in rows), (None, " ".join(a), 1, "x", 5)], "doc_id long, text string, row int, tag string, found int")
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = [(0, 30, 0, hashlib.sha256(" ".join(a).encode()).hexdigest())]
    for i, w in rows:
        drop = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(drop), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in drop).encode()).hexdigest()))
    assert sorted((x.doc_id or 0, x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(frame).collect()) == sorted(want)


def test_pipeline_in_plain_python(spark, tmp_path):
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    item = words(30)
    texts = [words(r.randint(1, 60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t.replace(" ", "\n")) for i, t in enumerate(texts[:8])] + [(3, texts[5]), (3, texts[3]), (3, texts[3]), (None, texts[9]), (None, "nobody knows"), (None, "nobody knows")]
    rows += [(200 + i, t + " more") for i, t in enumerate(texts) if len(t.split()) > 30] + [(300, f"{words(5)} {item} {words(5)}"), (1, f"{item.upper()} {words(9)}"), (301, None), (302, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))  # rejects nothing
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub(" ", t or "")].append(i)
    kept = [(min((i for i in ids if i is not None), default=None), body) for body, ids in groups.items()]
    sets = []
    for _, t in kept:
        w = split(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(kept)))

    def top(a):
        return a if root[a] == a else top(root[a])

    for a, (i, _) in enumerate(kept):
        for b, (j, _) in enumerate(kept[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    heads = {}
    for a, (i, t) in enumerate(kept):
        if i is None or not sets[a]:
            heads[a, None] = (i, t)
        elif (top(a), 0) not in heads or i < heads[top(a), 0][0]:
            heads[top(a), 0] = (i, t)
    want = sorted((i is None, i or 0, len(split(t))) for i, t in heads.values() if item not in t.lower())
    assert got == want and 20 < len(want) < len(kept)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in exact_dedup.mark_duplicates(docs).where("kept").collect()}
