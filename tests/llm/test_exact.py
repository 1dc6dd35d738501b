"""Operators with one right result, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.llm import context_mixing, dac, decontaminate, licenses, ngram_join, packing, rules, signature_tree, substrings
from tracewright.llm.components import components
from tracewright.llm.tokens import WordTokenizer, default_tokenizer


def words(text):
    return (text or "").encode().split()


def of(rows, *names):
    return sorted(([r[n] for n in names] for r in rows), key=lambda x: [(v is None, str(v)) for v in x])


def ids_of(texts):
    coder = WordTokenizer(default_tokenizer()).inner
    return {t: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for t in texts}


def test_tokenizer_is_exact_on_odd_texts():
    coder = WordTokenizer(default_tokenizer(), cached=8)
    odd = ["", " ", "İstanbul ǅ é x́", "don't it's I'LL", "<|endoftext|>abc a<|startoftext|>", "　wide nbsp x y", "12ab3 ...,, 'S !'s,'t", "\x1c a\x85b ſ K Å ﬁ", "中文 ½ Ⅳ 👍🏽 ,'re", "Écoß, ÜBER; word!!! word!! word"]
    for t in odd * 2:
        got = np.frombuffer(coder.encode([t.encode()])[0], "<u4").tolist()
        assert got == [*coder.inner.encode(t, add_special_tokens=False).ids, 2], t


def test_directly_addressable_codes_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, hi, n).astype(np.uint32) for n, hi in ((0, 10), (1, 2), (5000, 70000), (3000, 2**32), (700, 256))]
    seg = dac.Segment(dac.encode(docs))
    flat = np.concatenate(docs)
    assert (seg.ids() == flat).all()
    for i in (0, 1, 511, 512, 513, 4999, 5001, len(flat) - 1):
        assert seg[i] == flat[i]
    assert dac.Segment(dac.encode([])).ids().tolist() == []
    with pytest.raises(IndexError):
        seg[len(flat)]


def test_token_files(spark, docs, corpus, none, tmp_path):
    dac.write(docs, f"file://{tmp_path}/t")
    ids = ids_of({r[1] for r in corpus})
    got = dac.read(spark, f"file://{tmp_path}/t").collect()
    assert of([{"d": r["doc_id"], "i": tuple(r["ids"])} for r in got], "d", "i") == of([{"d": r[0], "i": tuple(ids[r[1]])} for r in corpus], "d", "i")
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert [x for x in order if x is not None] == sorted(x for x in order if x is not None)
    crc = {(r["doc_id"], r["ids_crc32"]) for r in dac.digests(spark, f"file://{tmp_path}/t").collect()}
    assert crc == {(r[0], zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in corpus}
    tied = spark.createDataFrame([(7, f"text {i % 5}") for i in range(40)] + [(None, "b"), (None, "a")], "doc_id long, text string")
    for k in (1, 3):
        dac.write(tied.repartition(k), f"file://{tmp_path}/k{k}", shards=k)
    starts = [sorted(map(tuple, dac.digests(spark, f"file://{tmp_path}/k{k}").select("start", "doc_id", "ids_crc32").collect())) for k in (1, 3)]
    assert starts[0] == starts[1]
    dac.write(none, f"file://{tmp_path}/e")
    assert dac.read(spark, f"file://{tmp_path}/e").count() == 0


def test_packing(docs, corpus, none):
    ids = ids_of({r[1] for r in corpus})
    rows = packing.pack(docs, capacity=256).collect()
    by_seq, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 256 and at == own[0]["sequence_tokens"]
        whole = [r["length"] == r["doc_tokens"] or r["doc_tokens"] > 256 for r in own]
        assert all(whole) or at & (at - 1) == 0  # only sequences without padding hold cut pieces of short documents
    assert sum(r["length"] for r in rows) == sum(len(ids[r[1]]) for r in corpus)
    single = Counter((r[0], len(ids[r[1]])) for r in corpus)
    for doc, text in {(r[0], r[1]) for r in corpus}:
        if doc is not None and single[doc, len(ids[text])] == 1:
            own, at = sorted(pieces[doc, len(ids[text])], key=lambda r: r["start"]), 0
            for r in own:
                assert r["start"] == at
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[text][at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(ids[text])
    assert packing.pack(none).count() == 0


def test_packing_has_little_padding_and_few_cuts():
    rng = np.random.default_rng(8)
    packer, rows, sizes = packing.Packer(0), [], np.minimum(rng.lognormal(5.8, 1.1, 6000).astype(int) + 1, 40_000)
    for doc, n in enumerate(sizes.tolist()):
        rows += packer.add(doc, np.full(n, doc, "<u4").tobytes())
    rows += packer.flush()
    padded = {r[5]: (r[7], r[8]) for r in rows}
    assert sum(r[2] for r in rows) == sizes.sum() == sum(n for n, _ in padded.values())
    assert sum(p for _, p in padded.values()) < 1.015 * sizes.sum()
    short = Counter(r[0] for r in rows if r[4] < 4096)
    assert sum(n > 1 for n in short.values()) <= 16


def test_differencing_gives_near_equal_sums():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 500)
    found = packing.difference(sizes, 20)
    assert sorted(i for x in found for i in x) == list(range(500))
    sums = [sizes[x].sum() for x in found]
    assert max(sums) - min(sums) <= 400 * 0.1
    assert all(sizes[x].sum() <= 1000 for x in packing.windows(sizes, 1000))
    assert packing.difference(np.array([], int), 3) == []


def test_substrings(docs, corpus, none):
    first, want = {}, []
    have = sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0])
    for d, t, *_ in have:
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t, *_ in corpus:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        want.append({"doc_id": d, "n_words": len(w), "n_removed": len(gone), "kept": hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()})
    got = [{**r.asDict(), "kept": hashlib.sha256(r["kept_text"].encode()).hexdigest()} for r in substrings.remove_repeats(docs, carry=("lang",)).collect()]
    names = ("doc_id", "n_words", "n_removed", "kept")
    assert of(got, *names) == of(want, *names)
    assert sum(r["n_removed"] for r in want) > 500
    assert substrings.remove_repeats(none).count() == 0


def test_every_shift_meets_in_the_cover():
    for v, d in substrings.COVERS.items():
        for a in range(v):
            for b in range(v):
                assert any((a + s) % v in d and (b + s) % v in d for s in range(v))


@pytest.mark.parametrize(("width", "num", "den"), [(4, 17, 20), (5, 4, 5)])
def test_similarity_classes(docs, corpus, none, width, num, den):
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if (w := words((r[1] or ""))) and (w := [x.lower() for x in w]) else frozenset() for r in corpus]
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(corpus):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = [{"doc_id": r[0], "n": len(sets[i]), "c": min(least[find(i)], default=None) if sets[i] else r[0]} for i, r in enumerate(corpus)]
    got = [{"doc_id": r["doc_id"], "n": r["n_shingles"], "c": r["component_id"]} for r in ngram_join.similarity_classes(docs, width, (num, den)).collect()]
    assert of(got, "doc_id", "n", "c") == of(want, "doc_id", "n", "c")
    assert ngram_join.similarity_classes(none).count() == 0


def test_large_groups_in_cells(docs, corpus, monkeypatch):
    """Frequent shingles dealt to several partitions lose no link."""
    plain = {(r["doc_id"], r["component_id"]) for r in ngram_join.similarity_classes(docs).collect()}
    monkeypatch.setattr(ngram_join, "CELL", 1)
    monkeypatch.setattr(ngram_join, "UNIT", 3)
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.similarity_classes(docs).collect()} == plain
    monkeypatch.setattr(ngram_join, "CELL", 20_000)
    monkeypatch.setattr(ngram_join, "UNIT", 500_000)
    monkeypatch.setattr(ngram_join, "SPLIT", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.similarity_classes(docs).collect()} == plain


def test_first_of_classes_chooses_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (None, a, 5), (None, c, 6), (7, "", 7), (8, None, 8), (8, None, 9), (9, "", 10), (6, a + " more", 11)]
    got = ngram_join.first_of_classes(spark.createDataFrame(rows, "doc_id long, text string, row_hash int")).collect()
    assert of([r.asDict() for r in got], "doc_id", "text") == sorted(([d, t] for d, t in [(1, a), (5, b), (None, c), (7, ""), (8, None), (9, "")]), key=lambda x: [(v is None, str(v)) for v in x])
    assert got[0].asDict().keys() == {"doc_id", "text", "row_hash"}


def test_signature_tree_keeps_every_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(20, 400, 60)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 2**63, 3).astype(np.uint64)])) for s in sets]
    wide = [np.frombuffer(signature_tree.bitmap(s), "<u8") for s in sets]
    sizes = np.array([len(s) for s in sets])
    tree = signature_tree.Tree(np.stack([signature_tree.folded(x) for x in wide]), sizes, np.arange(len(sets)))
    found = [tuple(sorted(p)) for i, j in tree.pairs(17, 20) for p in zip(i.tolist(), j.tolist(), strict=True)]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 20 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 17 * (len(sets[i]) + len(sets[j]) - b)}
    assert links and links <= set(found) and len(found) == len(set(found)) and len(found) < 5 * len(links)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 7), (20, 21), (21, 20), (None, 3), (30, None)], "a long, b long")
    assert {tuple(r) for r in components(e).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (20, 20), (21, 20)}
    assert components(e.limit(0)).count() == 0


def test_decontamination(spark, docs, corpus, none):
    t = [r[1] for r in corpus if r[1]]
    edited = t[7].split()[:30]
    edited[15] = "other"
    items = [(1, " ".join(t[0].split()[3:40])), (2, t[6].upper()), (3, "one two three"), (4, "nowhere to be found at all in here"), (5, None), (6, ""), (7, "one"), (8, " ".join(edited)), (None, "weiß über é ’ naïve"), (2, t[6])]
    table = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")

    def shingles(text):
        w = (text or "").lower().split()
        k = min(5, len(w))
        return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    own, want = defaultdict(set), set()
    for i, text in items:
        own[i] |= {(shingles(text)[0], s) for s in shingles(text)[1]}
    have = defaultdict(set)
    for d, text, *_ in corpus:
        w = (text or "").lower().split()
        have[d] |= {(k, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1)}
    for i, s in own.items():
        for d, h in have.items():
            if s and 5 * len(s & h) >= 4 * len(s):
                want.add((d, i, len(s), len(s & h)))
    assert {tuple(r) for r in decontaminate.find_contained(docs, table).collect()} == want and len(want) > 5
    assert decontaminate.find_contained(none, table).count() == 0
    assert decontaminate.find_contained(docs, table.limit(0)).count() == 0


def test_rules(docs, corpus, none):
    got = rules.apply_rules(docs).collect()
    want = []
    for d, text, *_ in corpus:
        t, w = text or "", words(text)
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        n = len(w)
        want.append({"doc_id": d, "n_words": n, "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "base_failed": n < 20 or 100 * len(rep) > 30 * n})
    names = tuple(want[0])
    assert of(got, *names) == of(want, *names)
    assert not any(r["kept"] and r["base_failed"] for r in got) and sum(r["kept"] for r in got) > 60
    assert rules.apply_rules(none).count() == 0


def test_sketches_bound_the_quantiles(spark):
    from pyspark.sql import functions as F

    df = spark.range(1, 5001).select(F.lit("l").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), *(F.col("id").alias(m) for m in rules.METRICS))
    parts = [rules.sketches(df.where(f"word_length % 3 = {i}")) for i in range(3)]
    whole = rules.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), "lang", "source")
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in rules.sketches(df).select(*whole.columns).collect()}
    for r in rules.quantiles(whole, "lang", "source", levels={m: (25, 50, 75) for m in rules.METRICS}).collect():
        assert all(abs(r[name] - x) <= x / 31 for name, x in (("low", 1250), ("middle", 2500), ("high", 3750)))


def test_fences_follow_their_group(spark):
    """Documents as usual in their own source pass; the same amounts are beyond the fence of another."""
    rng = random.Random(4)
    rows = []
    for i in range(800):
        code = i % 2 == 0
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(900)) for _ in range(60)]
        signs = rng.randrange(8, 30) if code else 0
        rows.append((i, " ".join(w) + " " + "#" * signs, "en", "code" if code else "prose"))
    rows += [(1000, " ".join(f"gammas{k + 10}" for k in range(60)) + " " + "#" * 20, "en", s) for s in ("code", "prose")]
    got = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    high = {m: {r[f"high_{m}"] for r in got} for m in rules.METRICS}
    assert len(high["symbol_share"]) == 2
    verdict = {r["high_symbol_share"] == max(high["symbol_share"]): r["kept"] for r in got if r["doc_id"] == 1000}
    assert verdict == {True: True, False: False}
    assert sum(r["kept"] for r in got if r["doc_id"] < 1000) > 780


def test_licences(spark, docs, none):
    model = licenses.train(docs)
    more = spark.createDataFrame([(1, "first line\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "plain words of no kind"), (3, None), (4, "Released under the MIT License."), (5, "the license of a driver was granted in version 2 of the form"), (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.")], "doc_id long, text string")
    got = {r["doc_id"]: list(r["families"]) for r in licenses.scan(more, model).collect()}
    assert got == {1: ["apache-2.0"], 2: [], 3: [], 4: ["mit"], 5: [], 6: ["mit"]}
    line = licenses.scan(more.where("doc_id = 1"), model).first()["found"][0]
    assert line["line"] == 1 and line["confirmed"]
    assert licenses.scan(none, model).count() == 0 and licenses.scan(more, licenses.train(none)).count() == 6


def test_language_model(docs, corpus, none):
    train = [r for r in corpus if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 10]
    c = Counter(w for r in train for w in [*(r[1] or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, text, *_ in corpus:
        w = [*(text or "").encode().lower().split(), None]
        want.append({"doc_id": d, "n_tokens": len(w), "n_known": sum(x in c for x in w), "train_tokens": n, "base": round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)})
    rows = context_mixing.score(docs).collect()
    got = [{**r.asDict(), "base": round(r["base_score"], 4)} for r in rows]
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base")
    assert of(got, *names) == of(want, *names)
    assert all(r["score"] < 0 for r in rows)
    assert context_mixing.score(none).count() == 0


def test_model_is_a_probability():
    """Codes of a vocabulary are complete, both bits of a node sum to 1, and so do the words that can be a token."""
    voc = context_mixing.Vocabulary([b"\n", b"aa", b"bb", b"cc"], np.array([9, 5, 3, 1]), 20)
    model = context_mixing.Model(voc, np.zeros((2, context_mixing.SLOTS), np.uint16), context_mixing.Mixer())
    total = 0.0
    for symbol in range(5):
        ev = voc.events([np.array([symbol])], [np.array([symbol])], 0, 1)
        total += np.exp(-model.costs(ev)[0].sum())
    assert abs(total - 1) < 1e-9
    letters = sum(np.exp(-model.costs(voc.spelling([bytes([c])]))[0][: voc.bytes.start[c + 1] - voc.bytes.start[c]].sum()) for c in range(256) if c != 32)
    space = voc.spelling([b""])
    assert abs(letters + np.exp(-model.costs(space)[0].sum()) - 1) < 1e-9
    assert model.score([[b"aa", b"zz"]])[0] < model.score([[b"aa"]])[0] < 0

def test_model_grows_with_the_corpus():
    """Slots and coded words grow with the tokens, and a context never takes another's counts for its own."""
    small, large = context_mixing.grown(1000), context_mixing.grown(100_000_000)
    assert small == (1 << 15, 1 << 19, 1 << 22) and large[2] >= 4 * small[2] and large[0] > small[0] and large[1] >= large[0]
    assert context_mixing.grown(10**13)[2] == context_mixing.MOST_SLOTS
    counts = np.array([0, 63, 64, 1000, 10**9, 10**13])
    assert (abs(context_mixing._LEVELS[context_mixing.quantised(counts)] - counts) <= 0.2 * counts).all()
    check = context_mixing.CHECK
    keys = np.array([2 * (5 << check | 3), 2 * (5 << check | 3) + 1, 2 * (5 << check | 9) + 1, 2 * (5 << check | 3) + 1])
    table = context_mixing.settled(keys, np.array([2, 3, 4, 1]))
    assert context_mixing.known(table, np.array([5 << check | 3, 5 << check | 9, 6 << check | 3])).tolist() == [2 * 256 + 4, 0, 0]


def test_scores_agree_with_a_model_of_single_bits(spark, docs, corpus):
    """A slow twin: one bit after the other, plain numbers, dictionaries for what a text has spelled."""
    cm = context_mixing
    texts = [(i, (r[1] or "").encode(), i % 5 == 0) for i, r in enumerate(corpus)]
    df = spark.createDataFrame(texts, "doc_id long, text binary, held_out boolean").repartition(2)
    counts = cm.token_counts(df)
    n = counts.agg({"c": "sum"}).first()[0]
    model = cm.train(df, counts, n)
    voc, (t1, t2), w = model.vocabulary, model.tables, model.mixer.w.astype(float)

    def slot(table, place):
        x = int(table[int(place) >> cm.CHECK])
        return (x >> 8 & 255, x & 255) if x >> 16 == int(place) & (1 << cm.CHECK) - 1 else (0, 0)

    def bits(ev, k, delta):
        _, bit, s0, i1, i2, kind = ev
        found = [slot(t, i[k]) for t, i in ((t1, i1), (t2, i2))]
        s = [float(s0[k])] + [math.log((cm._LEVELS[b] + 0.3) / (cm._LEVELS[a] + 0.3)) for a, b in found]
        sure = [sum(cm._LEVELS[a] + cm._LEVELS[b] >= x for x in (0.5, 2.5, 12.5)) for a, b in found]
        z = sum((x + d) * y for x, d, y in zip(w[kind * 16 + 4 * sure[0] + sure[1]], delta, s, strict=True))
        return math.log1p(math.exp(-z if bit[k] else z)), [(bit[k] - 1 / (1 + math.exp(-z))) * x for x in s]

    def spelled(word):
        ev = voc.spelling([word])
        p = math.exp(-sum(bits(ev, k, (0, 0, 0))[0] for k in range(len(ev[1]))))
        return -math.log(voc.new_share * p + (1 - voc.new_share) * voc.count(word) / voc.spelled_total)

    for _, text, _ in texts[:12] + texts[-5:]:
        words, places = cm.split(text), voc.places(cm.split(text))
        ids, contexts, delta, cost = voc.symbols(places), voc.contexts(places), [0.0] * 3, 0.0
        for lo, hi in cm.blocks(len(ids)):
            ev, g = voc.events([ids], [contexts], lo, hi), [0.0] * 3
            for k in range(len(ev[1])):
                c, own = bits(ev, k, delta)
                cost += c
                g = [a + b for a, b in zip(g, own, strict=True)]
            delta = [d + cm.RATE * min(200, max(-200, x)) for d, x in zip(delta, g, strict=True)]
        before = []
        for word, i in zip([*words, cm.END], ids, strict=True):
            if i == voc.escape:
                p = math.exp(-spelled(word))
                if before:
                    share = (sum(x in before[:k] for k, x in enumerate(before)) + 0.5) / (len(before) + 5)
                    p = (1 - share) * p + share * before.count(word) / len(before)
                cost -= math.log(p)
                before.append(word)
        assert abs(model.score([words])[0] + cost / math.log(10)) < 0.002 * max(10, cost)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    """Texts of a language of word pairs, held out: the model knows what follows what."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(300)]
    after = {x: [rng.choice(pool) for _ in range(3)] for x in pool}
    rows = []
    for i in range(600):
        w = [rng.choice(pool)]
        while len(w) < 80:
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.9 else rng.choice(pool))
        rows.append((i, " ".join(w)))
    held = [r for r in context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert held and np.mean([r["score"] > r["base_score"] for r in held]) >= 0.9


def test_tables_count_every_context(spark, tmp_path):
    """Counts by context, summed over tasks, are those of the bits themselves."""
    texts = [b"aa bb cc aa bb dd", b"bb cc aa", b"dd dd aa bb"]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text binary, held_out boolean").repartition(2)
    counts = context_mixing.token_counts(df)
    rows = sorted(counts.collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    voc = context_mixing.Vocabulary([bytes(r["token"]) for r in rows], np.array([r["c"] for r in rows]), sum(r["c"] for r in rows), 4)
    tables = context_mixing.context_tables(df, counts, voc)
    places = [voc.places(t.split()) for t in texts]
    _, _, *hashes = voc.after([voc.symbols(x) for x in places], [voc.contexts(x) for x in places], 0, None)
    of, _, _ = voc.words.expand(np.concatenate([voc.symbols(x) for x in places]))
    _, bit, _, *at, _ = voc.events([voc.symbols(x) for x in places], [voc.contexts(x) for x in places], 0, None)
    for table, i, h in zip(tables, at, hashes, strict=True):
        often = {x for x, k in Counter(h.tolist()).items() if k > 1}  # contexts that occur once aren't kept
        want = [[int(((i == x) & (bit == b)).sum()) if h[t] in often else 0 for b in (0, 1)] for x, t in zip(i, of, strict=True)]
        assert [divmod(int(k), 256) for k in context_mixing.known(table, i)] == [tuple(x) for x in want]


def test_licences_over_lines(docs):
    """Notices that are wrapped, in comments or among other lines, and SPDX names."""
    import textwrap

    spark, model = docs.sparkSession, licenses.train(docs)
    mit, gpl = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["gpl"][0]
    lines = textwrap.wrap(mit, 78)
    texts = [
        "\n".join(lines), "\n".join(f" * {x}" for x in lines), "intro words\n\n# " + "\n# ".join(textwrap.wrap(gpl, 60)) + "\n#\nmore",
        "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-2.0-only\nint main", "plain\nwords mit dem\nof no kind",
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [list(r["families"]) for r in got] == [["mit"], ["mit"], ["gpl"], ["mit"], ["gpl"], []]
    assert [x["line"] for x in got[2]["found"] if x["confirmed"]] == [2]


def test_licences_on_text_not_seen(docs):
    """Every notice in every wrapping is found, plain paragraphs of other documents raise no alarm, and probabilities are
    about as often right as they say."""
    import textwrap

    rng = random.Random(9)
    model, words = licenses.train(docs), licenses.Words()
    pool = [f"{a}{b}" for a in ("lo", "ra", "mi", "tu", "ve", "sha") for b in ("n", "ter", "dis", "qua", "", "pol", "xy")] + ["the", "license", "granted", "free", "public"]
    plain = lambda n: " ".join(rng.choice(pool) for _ in range(n))

    def families(text):
        x = licenses.Layout(text.encode(), words)
        return {y["family"] for y in licenses.found_in(x, [c[1:] for c in model.claims([x])]) if y["confirmed"]}

    hit, all_ = 0, 0
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for width in (50, 78, 1000):
                for mark in ("", "# ", " * "):
                    lines = [mark + x for x in textwrap.wrap(notice, width)]
                    hit += families("\n".join([plain(30), "", *lines, "", plain(30)])) == {family}
                    all_ += 1
    assert hit >= 0.97 * all_
    assert sum(bool(families("\n".join(plain(rng.randrange(3, 60)) for _ in range(8)))) for _ in range(300)) <= 1
    sure, right = [], []
    for k, some in [*model._positives(pool, 5, random.Random(3)), *((0, plain(30).split()) for _ in range(200))]:
        some = [w if isinstance(w, bytes) else w.encode() for w in some]
        p = model.probabilities(model.raw(words.hashes(some))[None])[0]
        sure.append(p.max())
        right.append(p.argmax() == k)
    assert abs(np.mean(sure) - np.mean(right)) < 0.1


def test_weights_are_fitted_on_every_bit(spark):
    """Newton's method over all bits of all training texts at once gives the same weights: of texts whose words change
    along the way, one of which is longer than what is fitted at once."""
    cm, rng = context_mixing, random.Random(5)
    kinds = [[f"{a}{i}" for i in range(60)] for a in "xyz"]
    texts = [" ".join(rng.choice(kinds[j * 3 // n]) if rng.random() < 0.9 else f"n{rng.randrange(10**6)}" for j in range(n)).encode() for n in (0, 1, 40, 3000, 5000, cm.STRETCH + 900)]
    df = spark.createDataFrame([(i, t, i == 2) for i, t in enumerate(texts)], "doc_id long, text binary, held_out boolean").repartition(2)
    counts = cm.token_counts(df).cache()
    seen = Counter({bytes(r["token"]): r["c"] for r in counts.collect()})
    words = sorted(seen, key=lambda w: (-seen[w], w))
    voc = cm.Vocabulary(words, np.array([seen[w] for w in words]), sum(seen.values()), 150)
    shared = spark.sparkContext.broadcast(voc)
    pieces = cm.pieces_of(cm.context_ranges(df, counts, shared, voc.slots))
    got, tables = cm.mixing_weights(df, counts, shared, pieces).w, cm.model_of(shared, pieces).tables
    parts = []
    for i, t in enumerate(texts):
        if i != 2:
            w = cm.split(t)
            places = voc.places(w)
            rare = voc.rare(w, places)
            parts += [voc.events([voc.symbols(places)], [voc.contexts(places)], 0, None)] + ([voc.spelling(rare)] if rare else [])
    x = [np.concatenate(c) for c in zip(*((*cm.Mixer.inputs(ev, tables, cm.lookup(True), True), ev[1]) for ev in parts), strict=True)]
    s, gate, bit = np.stack(x[:3], 1).astype(float), x[3], x[4]
    for g in range(cm.Mixer.GATES):
        own, first = s[gate == g], cm.Mixer().w[g].astype(float)
        w = first.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-own @ w))
            w += np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + 50 * np.eye(3), own.T @ (bit[gate == g] - p) - 50 * (w - first))
        assert abs(own @ (got[g] - w)).max(initial=0) < 0.1, g


def test_the_driver_holds_no_table(spark, monkeypatch):
    """Tables go to the workers in packed pieces; only workers put them together, and the pieces make the same model."""
    cm = context_mixing
    df = spark.createDataFrame([(i, f"aa bb cc w{i % 7} dd " * (i + 1)) for i in range(30)], "doc_id long, text string")
    want = sorted((r["doc_id"], r["score"]) for r in cm.score(df).collect())

    def refused(*_):
        raise AssertionError("a table in the driver")

    monkeypatch.setattr(cm, "assembled", refused)
    monkeypatch.setattr(cm, "PIECE", 100)
    assert sorted((r["doc_id"], r["score"]) for r in cm.score(df).collect()) == want


def test_workers_of_an_executor_hold_the_tables_once(tmp_path, monkeypatch):
    """The first of two processes of one parent makes them, the second finds them; they go with the processes."""
    import os
    import tempfile
    import zlib as z

    cm = context_mixing
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    slots = 2 * cm.RANGE
    data = np.arange(4 * cm.RANGE, dtype="<u4").reshape(4, -1)
    ranges = [(k, z.compress(data[k].tobytes())) for k in (0, 1, 3)]

    def refused():
        raise AssertionError("made twice")
        yield

    def child(parts, then):
        told, tell = os.pipe()
        wait, go = os.pipe()
        if not (pid := os.fork()):
            try:
                found = cm.shared_tables("k", parts, slots).reshape(4, -1)
                ok = all((found[k] == (0 if k == 2 else data[k])).all() for k in range(4))
                os.write(tell, b"y" if ok else b"n")
                os.read(wait, 1)
            finally:
                os._exit(0)
        os.close(tell)
        answer = os.read(told, 1)
        then and then()
        os.write(go, b"x")
        os.waitpid(pid, 0)
        return answer

    inner = []
    assert child(ranges, lambda: inner.append(child(refused(), None))) == b"y" and inner == [b"y"]
    assert child(refused(), None) == b""  # nobody holds them any more, so that they are made anew
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 100


def test_counted_words_take_few_bytes_in_a_worker(monkeypatch):
    """Words without a code are found by hash and letters, also where hashes clash; a dict took some 150 bytes each."""
    import pickle
    import tracemalloc

    cm = context_mixing
    words = [b"\n", *(b"w%d" % (7 * i) for i in range(100_000))]
    voc = pickle.loads(pickle.dumps(cm.Vocabulary(words, np.arange(len(words), 0, -1), 10**10, 100)))  # noqa: S301
    asked = [b"w%d" % i for i in range(0, 800_000, 13)] + [b"", b"w", b"w7 w14"]
    where = {w: i for i, w in enumerate(words)}
    tracemalloc.start()
    voc.places([])
    assert tracemalloc.get_traced_memory()[0] < 30 * len(words)
    tracemalloc.stop()
    assert voc.places(asked).tolist() == [where.get(w, -1) for w in asked] + [0]
    assert voc.places(asked, True).tolist() == [i if i < 100 else -1 for i in (where.get(w, -1) for w in asked)] + [0]
    assert voc.count(b"w7") == len(words) - 2 and voc.count(b"w8") == 0
    monkeypatch.setattr(cm, "word_hashes", lambda w: np.fromiter((len(x) % 2 for x in w), np.uint64, len(w)))
    few = cm.Vocabulary(words[:60], np.arange(60, 0, -1), 10**4, 5)
    assert few.places(asked[:200]).tolist() == [i if i < 60 else -1 for i in (where.get(w, -1) for w in asked[:200])] + [0]
    assert cm.Vocabulary([], np.array([], np.int64), 0).places([b"a"]).tolist() == [-1, -1]


def test_bits_of_a_repeated_token_are_taken_once(spark, monkeypatch):
    """The CPU seconds of scoring and of the fit: a token after the same two, or a letter after the same four, is looked up
    once for all texts at hand; and a path through a group of nodes stays in one line of a table."""
    cm = context_mixing
    texts = [(b"aa bb cc dd zebra%d yy " % (i % 3)) * 40 for i in range(50)]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text binary, held_out boolean").repartition(2)
    model = cm.train(df, cm.token_counts(df), 50 * 241)
    voc, taken, took = model.vocabulary, [0], cm.Vocabulary.bits_of
    words = [cm.split(t) for t in texts]
    alone = [model.score([w])[0] for w in words]

    def counted(self, code, symbols, *contexts):
        taken[0] += len(symbols)
        return took(self, code, symbols, *contexts)

    monkeypatch.setattr(cm.Vocabulary, "bits_of", counted)
    model.seen[:] = np.nan
    assert np.allclose(model.score(words), alone, rtol=1e-9, atol=0)
    assert 0 < taken[0] < 100 < sum(map(len, words)) / 100
    kinds, times = cm.summed(np.concatenate([voc.token_kinds([voc.symbols(x)], [voc.contexts(x)]) for x in voc.places_of(words)]))
    assert times.sum() == 50 * 241 and len(kinds) < 100
    many = cm.Vocabulary([b"\n", *(b"w%d" % i for i in range(5000))], np.arange(5001, 0, -1), 10**8)
    of, _, _, place, *_ = many.events([np.array([4000])], [np.array([4000])], 0, 1)
    assert len(of) > 8 and len(set((place >> cm.CHECK + 4).tolist())) <= -(-len(of) // 4)


def test_places_of_many_texts_are_those_of_each(monkeypatch):
    """By Arrow for many words at once and by a dict for few, also where counted words' hashes clash."""
    cm = context_mixing
    voc = cm.Vocabulary([b"\n", *(b"w%d" % i for i in range(400))], np.arange(401, 0, -1), 10**6, 50)
    texts = [[b"w%d" % (i * j % 500) for i in range(j)] for j in range(40)] + [[]]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(cm, "word_hashes", lambda w: np.fromiter((len(x) % 2 for x in w), np.uint64, len(w)))
            voc.tables = None
        for coded in (False, True):
            want = [[i if i <= 400 and (i < 50 or not coded) else -1 for i in (int(w[1:]) + 1 for w in t)] + [0] for t in texts]
            assert [x.tolist() for x in voc.places_of(texts, coded)] == want
            assert [voc.places(t, coded).tolist() for t in texts] == want
