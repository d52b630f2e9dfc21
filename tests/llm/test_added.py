"""Prefix trie, toxicity and vector codes against plain Python."""

import gzip
import hashlib
import ipaddress
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketlake.llm import common, decontamination, exact_dedup, jaccard_join, prefix_trie, quality, sharding, surrogates, toxicity, vector_codes, warc

TALK = "conv_id long, turn long, role string, text string, k1 long, depth string"


def plain_turns(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            talks.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(x[1], x[3]) for x in sorted(v)] for c, v in talks.items()}


def plain_trie(talks):
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(talks[c]) == len(node)))
        children = sum(len(n) == len(node) + 1 for n in below)
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest(), len(below)))
    return sorted(out, key=str)


def talks(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c * 3 - 20, t, r.choice(["user", None]), r.choice(["a", "b", "é", ""]) if t else "first"))
    rows += [(7, t, "user", "long" if t < 40 else str(t)) for t in range(45)]  # one conversation with many turns
    rows += [(8, t, "user", "long") for t in range(41)]
    rows += [(9, None, "user", None), (9, 1, None, "x"), (9, 1, None, "x"), (9, 1, "a", "y"), (None, 1, "user", "none")]
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(common, "FEW", 8)  # most keys meet by hash
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = talks(block)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], TALK).repartition(5)
    got = prefix_trie.conversation_trie(df).collect()
    size = lambda r: (*r[:8], r.subtree_end - r.preorder + 1)
    assert sorted((size(r) for r in got), key=str) == plain_trie(plain_turns(rows))
    assert sorted(r.preorder for r in got) == list(range(1, len(got) + 1))
    whole = next(r for r in got if r.depth == 0)
    assert (whole.preorder, whole.subtree_end) == (1, len(got))


def test_rebuilt_conversations(spark, tmp_path):
    rows = talks(1)
    spark.createDataFrame([(*r, 1, "clash") for r in rows], TALK).write.parquet(str(tmp_path / "conversations.parquet"))
    own = plain_turns(rows)
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    got = prefix_trie.op11_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((r[:8] for r in plain_trie(made)), key=str)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TALK)).count() == 0
    only = prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", 1, "")], TALK))
    assert only.count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, v string, code int"


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, errors):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by[label]) for (i, _, label), f, err in zip(kept, found, errors)), key=str), books


@pytest.mark.parametrize("spread", [0.01, 1.0, 5e4])
def test_vector_codes(spark, monkeypatch, spread):
    monkeypatch.setattr(common, "FEW", 3)
    r = random.Random(3)
    rows = [(i, [round(r.gauss(0, spread), 6) for _ in range(8)], r.choice([1, 2, None]), "clash", 1) for i in range(200)]
    rows += [(5, rows[5][1], 1, "", 0)] * 3 + [(None, rows[9][1], 2, "", 0), (300, None, 1, "", 0), (301, [None] + [0.0] * 7, 1, "", 0), (302, [float("nan")] * 8, 1, "", 0), (303, [float("inf")] * 8, 1, "", 0)]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(4), parts=4, entries=9, rounds=3)
    want, plain = plain_codes(rows, 4, 9, 3, 4096)
    assert sorted((tuple(x) for x in codes.collect()), key=str) == want
    assert [[list(map(int, e)) for e in b] for b in books.entries] == plain
    assert np.abs(vector_codes.decode(want[0][1], books)).max() < 6 * spread


def test_vector_codes_of_few_or_no_vectors(spark):
    codes, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert codes.count() == 0 and books is None
    codes, books = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8, None, "", 0), (2, [0.5] * 8, None, "", 0)], VECTORS))
    assert [tuple(x) for x in codes.orderBy("vec_id").collect()] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 8, None, "", 0), (2, [0.5] * 9, None, "", 0)], VECTORS))


def test_tree_search_is_exact_and_leaves_entries_out():
    r = np.random.default_rng(1)
    book = np.concatenate([r.integers(-50, 50, (60, 3)), r.integers(-50, 50, (4, 3)).repeat(2, axis=0)])  # with entries that are equal
    points = np.concatenate([r.integers(-80, 80, (500, 3)), book])
    found = vector_codes.Search(vector_codes.tree(book), book, points)
    squares = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found.code == squares.argmin(axis=1)).all() and (found.best == squares.min(axis=1)).all()
    assert found.compared < 0.6 * squares.size
    low, high = vector_codes.roots(np.array([0, 1, 2, 4, (1 << 60) - 1, 1 << 60]))
    assert low.tolist() == [0, 1, 1, 2, (1 << 30) - 1, 1 << 30] and high.tolist() == [0, 1, 2, 2, 1 << 30, 1 << 30]


DOCS = "doc_id long, text string, lang string, score double, toxic int"


def toxic_corpus(n=900, seed=4):
    r = random.Random(seed)
    words = {lang: ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(200)] for lang in ("x", "y")}
    docs, labels = [], []
    for i in range(n):
        lang = r.choice("xy")
        text = [r.choice(words[lang]) for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.2
        if bad:  # in the one language words, in the other a stem with endings
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(["Slur!", "insult"]) if lang == "x" else "zuzzo" + "".join(r.choice("abcdef") for _ in range(3)))
        docs.append((i, " ".join(text), lang, 0.5, 9))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus()
    extra = [(900, None, None, 0.0, 0), (901, "", "x", 0.0, 0), (None, "slur slur", "x", 0.0, 0), (902, "plain " * 200_000 + "insult slur", "x", 0.0, 0), (903, docs[0][1], "y", 1.0, 1)]
    df = spark.createDataFrame(docs + extra, DOCS)
    marks = spark.createDataFrame([*labels, (0, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(df, marks, F.col("doc_id") % 3 != 1)
    got = toxicity.flagged(toxicity.score(df, net), net).collect()
    assert len(got) == len(docs) + len(extra)
    by_id = {r.doc_id: r for r in got}
    held = [(by_id[i], y) for i, y in labels if i % 3 == 1]
    right = lambda flags: sum(f == bool(y) for f, (_, y) in zip(flags, held)) / len(held)
    assert right([r.score >= 0.7 for r, _ in held]) > 0.95 and right([r.toxic for r, _ in held]) > 0.95
    assert by_id[900].score == by_id[901].score < 0.5 and by_id[None].toxic and by_id[902].score > 0.5
    assert by_id[903].score == by_id[0].score and set(net.by_language) == {"x", "y"}
    again = toxicity.score(df.select("doc_id", "text").repartition(3), net).collect()
    assert all(math.isclose(r.score, by_id[r.doc_id].score, rel_tol=1e-3, abs_tol=1e-6) for r in again)


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0.0, 0), (2, None, None, 0.0, 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks, want in ((none, 0.0), (spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), 1.0)):
        net = toxicity.fit(docs, marks)
        assert [round(r.score, 6) for r in toxicity.score(docs, net).collect()] == [want, want]
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_toxicity_learns_all_labelled_documents(spark, monkeypatch):
    """A word of those toxic documents only that come last by hash is learned, too, and partitions do not change the network."""
    ids = spark.range(8800)
    late = {r.id for r in ids.where("id % 2 = 1").orderBy(F.xxhash64("id", F.lit(31)), "id").collect()[4000:]}
    r = random.Random(7)
    plain = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda i: " ".join([*r.sample(plain, 6), ("grobian" if i in late else "insult") if i % 2 else r.choice(plain)])
    docs = spark.createDataFrame([(i, text(i), "x", 0.0, 0) for i in range(8800)] + [(9000, "grobian", "x", 0.0, 0), (9001, "insult", "x", 0.0, 0), (9002, plain[0], "x", 0.0, 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8800)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id >= 9000"), net).collect()}
    assert len(late) == 400 and got[9000] > 0.7 and got[9001] > 0.7 and got[9002] < 0.3
    monkeypatch.setattr(toxicity, "UNIT", 300)
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    few = docs.where("doc_id % 5 = 0")
    nets = [toxicity.fit(few.repartition(n), labels.repartition(n)) for n in (2, 5)]
    assert (nets[0].embeddings == nets[1].embeddings).all() and nets[0].threshold == nets[1].threshold


def test_peaks_of_a_long_text_in_pieces(monkeypatch):
    r = np.random.default_rng(3)
    net = toxicity.begun(r.integers(0, 3, (2, (1 << toxicity.BITS) + 1)).astype(np.float32), np.array([5.0, 5.0], np.float32))
    words = r.integers(1, 1 << toxicity.BITS, (200, 5)).astype(np.int32)
    words[[118, 119, 198, 199]] = 0
    blank, bounds = words[:, 0] == 0, np.array([0, 120, 200])
    whole = toxicity.peaks(net, words, blank, bounds)
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 17)
    pieces = toxicity.peaks(net, words, blank, bounds)
    assert (whole[0] == pieces[0]).all() and np.allclose(whole[1], pieces[1], atol=1e-6)


def test_gradients_agree_with_differences():
    r = np.random.default_rng(2)
    words = r.integers(1, 30, (12, 5)).astype(np.int32)
    words[[4, 5, 10, 11]] = 0
    bounds = np.array([0, 6, 12])
    net = toxicity.Network(r.normal(0, 1, (31, toxicity.WIDTH)), r.normal(0, 1, (toxicity.WIDTH, int(toxicity._COLUMNS[-1]))), r.normal(0, 1, len(toxicity.SPANS) * toxicity.FILTERS))
    net.embeddings[0] = 0
    x, blank = net.embedded(words), words[:, 0] == 0
    y = net.responses(x, blank)
    at = np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:])])
    error = np.array([1.0, -0.5], np.float32)
    by_filter, row, by_row = toxicity.gradients(net, words, blank, error, at, x)
    loss = lambda: float((error * net.output(words, bounds)).sum())
    for table_, place, want in [(net.filters, (3, 2), by_filter[3, 2]), (net.filters, (0, 50), by_filter[0, 50]), (net.embeddings, (int(row[0]), 1), by_row[0, 1])]:
        before, kept = loss(), table_[place]
        table_[place] += 1e-3
        assert abs((loss() - before) / 1e-3 - want) < 0.02 * max(1, abs(want))
        table_[place] = kept


def test_index_of_a_block_is_bounded_and_blocks_agree(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    long = [(i, " ".join(word() for _ in range(5000))) for i in range(36)]
    index = decontamination.build_index(long)
    size = sum(v.nbytes for v in vars(index).values() if isinstance(v, np.ndarray))
    assert 0.9 * decontamination.BLOCK_BYTES < sum(len(t) for _, t in long) and size < 100 << 20
    items = [(i, " ".join(word() for _ in range(40))) for i in range(30)]
    texts = [(i, " ".join(word() for _ in range(50)) + " " + (items[i % 30][1] if i % 3 else "") + " end") for i in range(90)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontamination.contamination(docs, bench).collect()))
    kept = sorted(map(tuple, decontamination.drop_contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, decontamination.contamination(docs, bench).collect())) == one and sum(x[1] for x in one) == 60
    assert sorted(map(tuple, decontamination.drop_contaminated(docs, bench).collect())) == kept and len(kept) == 30


def test_warc_identifiers_do_not_depend_on_partitions(spark):
    rows = [(i % 40, f"http://x/{i % 40}", f"<p>{i % 40}") for i in range(80)] + [(7, None, None), (7, None, None), (8, "u", None), (8, None, "u")]
    rows += [(99, "same", "page")] * 50
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    ids = [sorted(r.record_id for r in warc.derivatives(df.repartition(n)).select("record_id").collect()) for n in (1, 5, 9)]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == 2 * len(rows)


def http(body, *headers):
    block = "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + body
    return warc.record("response", {"WARC-Record-ID": "<urn:x>", "WARC-Date": "d", "WARC-Target-URI": "u"}, block)


def test_warc_bodies_are_read_as_their_headers_say():
    text = lambda raw: warc.parse(warc.derive(raw)[1])[1].decode()
    page = "<p>café"
    assert text(http(page.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1")) == "café"
    assert text(http(b"<meta http-equiv=x content='text/html; charset=windows-1252'>" + page.encode("cp1252"))) == "café"
    assert text(http(page.encode(), "Content-Type: text/html; charset=nonsense")) == "café"
    assert text(http(gzip.compress(page.encode()), "Content-Encoding: gzip")) == "café"
    assert text(http(zlib.compress(page.encode()), "Content-Encoding: deflate")) == "café"
    assert text(http(page.encode(), "Content-Encoding: gzip")) == "café"  # says so, but is not
    chunks = b"4\r\n<p>c\r\n5;x=y\r\naf\xc3\xa9!\r\n0\r\n\r\n"
    assert text(http(chunks, "Transfer-Encoding: chunked")) == "café!"
    assert text(http(gzip.compress(page.encode())[:-4], "Content-Encoding: gzip")) == "café"
    for kind in ("request", "warcinfo", "metadata"):
        assert warc.derive(warc.record(kind, {"WARC-Record-ID": "<urn:y>"}, b"GET / HTTP/1.1\r\n\r\n")) == ()


def test_warc_links_take_linear_time(spark):
    began = time.time()
    for page in ("<a " * 350_000, "<img src" * 130_000, "<link " * 170_000, "<a href='" * 120_000, "<a href = " * 100_000, "<meta " * 170_000):
        warc.derive(warc.response("u", page))
    assert time.time() - began < 30
    raws = [http(b"<a class=x href=/y>z</a>"), b"", None, b"WARC/1.0\r\n\r\n", warc.record("request", {}, b"")]
    got = warc.derived_records(spark.createDataFrame([(r,) for r in raws], "record binary")).collect()
    assert sorted(r.warc_type or "" for r in got) == ["", "", "", "conversion", "metadata"] and sum(r.error is not None for r in got) == 3


def test_quality_learns_from_documents_that_there_are(spark):
    good, bad = "A plain and readable sentence about the weather in spring. ", "$$$ ### buy buy buy %%% "
    docs = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(60)]
    rows = [(i, t, "en", "s") for i, t in docs] + [(0, good, "en", "s"), (3, (bad + good) * 60_000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = [(i, i % 2, 0) for i in range(60)] + [(i, 0, 0) for i in range(1000, 4000)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [sorted((r.doc_id, round(r.p_document, 6)) for r in quality.classify(df.repartition(n), labels, sample=60).collect()) for n in (2, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by = {}
    for i, p in got[0]:
        by.setdefault(i, []).append(p)
    assert all(p > 0.5 if i % 2 else p < 0.5 for i, ps in by.items() if len(ps) == 1 for p in ps)


def test_surrogates_stay_valid_and_in_their_range():
    key = b"k"
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    for text in ibans:
        new = surrogates.surrogate("iban", text, key)
        bare = new.replace(" ", "")
        assert new != text and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        assert (new[:2], len(new), [c == " " for c in new]) == (text[:2], len(text), [c == " " for c in text])
    wrong = [f"DE{k:02d}370400440532013000" for k in range(100)]
    made = {surrogates.surrogate("iban", x, key) for x in wrong}
    assert len(made) == 100 and sum(surrogates._mod97(x) == 1 for x in made) == sum(surrogates._mod97(x) == 1 for x in wrong)
    ranges = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4", "100.64.0.0/10", "0.0.0.0/8")]
    r = random.Random(3)
    addresses = {str(n[r.randrange(min(n.num_addresses, 1 << 32))]) for n in ranges for _ in range(40)} | {str(ipaddress.ip_address(r.getrandbits(32))) for _ in range(300)} | {"9.255.255.255", "11.0.0.0", "223.255.255.255", "1.0.0.0", "192.167.255.255"}
    made = {x: surrogates.surrogate("ip", x, key) for x in addresses}
    assert len(set(made.values())) == len(made) and all(k != v for k, v in made.items())
    of = lambda x: [ipaddress.ip_address(x) in n for n in ranges]
    assert all(of(k) == of(v) for k, v in made.items())


def test_surrogates_against_plain_replacement(spark):
    r = random.Random(5)
    people = ["Anna Berg", "Iris-Maria", "Bo", "Carl Dahl"]
    things = {"mail": "anna.berg@site.example.org", "ip": "10.1.2.3", "ssn": "123-45-6789", "card": "4111 1111 1111 1111"}
    docs = []
    for i in range(40):
        known = r.sample(people, r.randint(0, 3))
        parts = [f"Dr {p}" for p in known] + [r.choice([p, p.split(" ")[-1], p.upper()]) for p in people] + r.sample(sorted(things.values()), 2) + ["plain", "words", "7"]
        r.shuffle(parts)
        docs.append((i, " , ".join(parts), known))
    got = {x.doc_id: x for x in surrogates.replace_entities(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), b"k").collect()}
    kind_of = {v: {"mail": "email"}.get(k, k) for k, v in things.items()}
    for i, text, known in docs:
        spellings = {x for p in known for x in (p, *p.split(" "))}
        spellings |= {x.upper() for x in spellings}
        want = []
        for part in text.split(" , "):
            title, name = ("Dr ", part[3:]) if part.startswith("Dr ") else ("", part)
            if name in spellings:
                want.append(title + surrogates.surrogate("name", name, b"k"))
            elif " " in name and kind_of.get(name) is None and name.split(" ")[-1] in spellings:
                want.append(" ".join(surrogates.surrogate("name", w, b"k") if w in spellings else w for w in name.split(" ")))
            else:
                want.append(surrogates.surrogate(kind_of[name], name, b"k") if name in kind_of else part)
        assert got[i].text == " , ".join(want)


def test_mentions_take_linear_time():
    took = []
    for n in (4000, 16_000):
        names = [f"N{''.join(chr(97 + int(c)) for c in str(i))} M{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(n)]
        text = ", ".join(names + [x.split(" ")[0] for x in names])
        began = time.time()
        assert sum(1 for _ in surrogates.mentions(text, set(names), [])) == 2 * n
        took.append(time.time() - began)
    assert took[1] < 2 and took[1] < 12 * max(took[0], 0.02)


def test_sharding_in_plain_python(spark):
    r = random.Random(8)
    texts = ["t" * r.randint(0, 400) + str(r.randint(0, 60)) for _ in range(500)] + ["same"] * 120 + [None, ""] * 5
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.shard_documents(df, 24).collect()
    groups, load = {}, [0] * 24
    for x in got:
        body = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32) == (len(body) + 8, zlib.crc32(body))
        groups.setdefault(body, set()).add(x.shard)
        load[x.shard] += x.size
    assert all(len(v) == 1 for v in groups.values())
    slots = {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    weights = {}
    for t in texts:
        weights[(t or "").encode()] = weights.get((t or "").encode(), 0) + len((t or "").encode()) + 8
    plain = [0] * 24
    for w in sorted(weights.values(), reverse=True):  # the largest group to the lightest shard
        plain[plain.index(min(plain))] += w
    assert max(load) - min(load) <= max(plain) - min(plain)


def test_pairs_between_components_only(spark):
    rows = [("k", i, 100 * jaccard_join.PACK, 1) for i in range(400)] + [("k", 1000 + i, 100 * jaccard_join.PACK, 1000 + i) for i in range(3)] + [("j", 5, 100 * jaccard_join.PACK, 1), ("j", 1001, 100 * jaccard_join.PACK, 1001)]
    placed = spark.createDataFrame(rows, "key string, node long, n long, c long")
    got = {tuple(r) for r in jaccard_join._cross(placed).collect()}
    want = {(min(a, b), max(a, b)) for k, a, _, c in rows for l, b, _, d in rows if k == l and c != d}
    assert got == want and len(got) == 400 * 3 + 3


def test_near_duplicates_in_batches_bounded_by_bytes(spark, monkeypatch):
    """Every table on the way is made with small batches; the bound holds for long texts side by side, and ends with the join."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, write = spark.conf.get(name), [], common.written

    def noted(df, table):
        seen.append(df.sparkSession.conf.get(name))
        return write(df, table)

    monkeypatch.setattr(jaccard_join, "written", noted)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16)
    r = random.Random(5)
    words = [r.choice("abcdefgh") * r.randint(2, 9) + str(i) for i in range(2000)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"w{i}"])) for i in range(60)] + [(100, "other text")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100}
    assert seen and set(seen) == {str(1 << 16)} and spark.conf.get(name) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    with common.small_batches(spark):
        most = docs.repartition(1).select("text").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert most < (1 << 16) + 2 * len(docs.first().text)


def test_near_duplicates_in_plans_of_few_exchanges(spark, monkeypatch):
    """What the driver holds of a plan and its stages' tasks grows with the exchanges that run at once; the join's tables are made one after the other."""
    exchanges, write = {}, common.written

    def noted(df, name):
        n = df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
        exchanges[name] = max(n, exchanges.get(name, 0))
        return write(df, name)

    monkeypatch.setattr(common, "written", noted)
    monkeypatch.setattr(jaccard_join, "written", noted)
    chain = [f"w{i}" for i in range(140)]
    docs = spark.createDataFrame([(i, " ".join(chain[i : i + 100])) for i in range(0, 40, 4)] + [(99, "other text")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {**{i: 0 for i in range(0, 40, 4)}, 99: 99}
    assert {"late", "edges", "placed"} <= set(exchanges) and max(exchanges.values()) <= 9, exchanges


def test_components_of_a_star_forest_take_one_round(spark, monkeypatch):
    rounds, write = [], common.written

    def noted(df, name):
        rounds.append(name)
        return write(df, name)

    monkeypatch.setattr(common, "written", noted)
    stars = [(i, i % 3) for i in range(3, 30)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i % 3 for i in range(30)} and rounds == ["edges"] * 2
    assert common.components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def test_exact_dedup_of_one_large_group(spark, monkeypatch):
    """A group of half of the rows, joined in place, beside groups that meet by hash."""
    monkeypatch.setattr(common, "FEW", 4)
    rows = [(i, "one  text" if i % 2 else f"text {i % 60}") for i in range(400)]
    got = {r.doc_id: r for r in exact_dedup.mark_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(" ".join(t.split()), []).append(i)
    assert len(got) == len(rows)
    for ids in groups.values():
        assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (ids[0], len(ids), i == ids[0]) for i in ids)
