"""Importance resampling, Merkle manifests and language identification against brute force."""

import hashlib
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from mercantile.llm import decontam, importance, language, licenses, lm_score, manifest, minhash, ranks, toxicity
from mercantile.llm.queries import QUERIES

from .test_operators import ODD, sha, words


def thue_morse(n, swap=False):
    a, b = "ba" if swap else "ab"
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def brute_importance(docs, target, n=1, buckets=10_000, percent=10, least=20, seed="2024"):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(map(bucket, features(text)))
    for text in target:
        wanted.update(map(bucket, features(text)))
    s_all, t_all = sum(corpus.values()) + buckets, sum(wanted.values()) + buckets
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((corpus[b] + 1) * t_all))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    enough = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0], x[1]))
    for k, x in enumerate(enough[: len(enough) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_importance(spark, monkeypatch, n):
    """Runs of several words, chunks of a few documents, ties, repeated and odd rows."""
    monkeypatch.setattr(importance, "CHUNK", 200)
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(["a", "b", "Cc", "dé"], rng.integers(0, 40)))) for i in range(120)]
    docs = [*ODD, *texts, *texts[:20]]
    target = ["a b a b", None, "", "cc a"]
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, rank string, weight double").repartition(3)
    got = importance.importance(frame, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=50, percent=30)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str) == brute_importance(docs, target, n, 50, 30)


def test_importance_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.importance(none, none).count() == 0
    assert importance.importance(some, none, percent=100).collect()[0]["rank"] == 1


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))

    def climb(nodes):
        """The top, and each node's list of (place in its run, the run)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
            for path, a in zip(paths, at, strict=True):
                path.append((a % 3, runs[a // 3]))
            at, nodes = [a // 3 for a in at], [sha("".join(run)) for run in runs]
        return nodes[0] if nodes else None, paths

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        low[s] = climb([x[2] for x in trees[s]])
    root, above = climb([low[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, _, leaf, r), path in zip(trees[s], low[s][1], strict=True):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            d = sha("".join(map(field, (*r[:4], text))))
            proof = ""
            for a, run in path + up:
                proof += "".join(x for i, x in enumerate(run) if i != a)
                d = sha("".join(d if i == a else x for i, x in enumerate(run)))
            out.append((r[0], leaf, low[s][0], root, sha(proof), d, d == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["one source", "many sources", "odd", "single", "empty"])
def test_manifest(spark, tmp_path, case):
    rng = np.random.default_rng(7)
    body = [(i, f"s{i % 4}" if i % 3 else "hot", "en", i, f"line {i}\nline") for i in map(int, rng.permutation(200))]
    cases = {
        "one source": [(i, "s", l, n, t) for i, _, l, n, t in body[:28]],
        "many sources": [(i, f"é{i}", l, n, t) for i, _, l, n, t in body[:10]] + body,
        "odd": [(i, None if (i or 0) % 2 else "s", None, None, t) for i, t in ODD] + body[:3] + body[:3] + [(None, "s", "", 0, "\n"), (2, "", None, 1, "a\nb")],
        "single": [(4, "s", None, None, "x\ny")],
        "empty": [],
    }
    rows = cases[case]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_places(spark):
    """A group that holds most rows, rows equal in all columns, null groups, one value."""
    rows = [("hot", i % 7) for i in range(500)] + [(None, 1)] * 5 + [("x", 3)] * 40
    got = ranks.places(spark.createDataFrame(rows, "g string, v int").repartition(5), [ranks.F.col("v").desc()], by="g", name="p").collect()
    for g in ("hot", None, "x"):
        own = sorted((r["p"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted((v for _, v in own), reverse=True)


def test_language_query(spark, sf_dir):
    """Held-out documents, which were not learnt from, by their language."""
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op13_language_id"](spark, sf_dir).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_vector(text):
    """A text's bundle, three-gram by three-gram."""
    runs = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    s = " ".join(["", *runs, ""]) if runs else ""

    def vector(c):
        return np.random.default_rng([language.SEED, ord(c)]).integers(0, 2, language.SIZE, np.int8).astype(int) * 2 - 1

    out = np.zeros(language.SIZE)
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_language_vectors(monkeypatch):
    """Bundles over blocks of a few cells, against one three-gram at a time."""
    texts = ["Ab cab, ab!", "", "ÉÑ é", "1 2", "x", "a\nb " * 50, "ßßß ИИИ 漢字 x"]
    raw = [t.encode() for t in texts]
    byte, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for cells in (1, 50, 1 << 22):
        monkeypatch.setattr(language, "CELLS", cells)
        three, which, row = language.grams(*language.symbols(byte, off))
        assert np.array_equal(language.bundles(three, which, row, len(texts)), [plain_vector(t) for t in texts])


def test_language_odd(spark):
    train = [(100 + i, t, l) for i, (t, l) in enumerate([("the cat and the dog are there", "en"), ("le chat et le chien sont là", "fr"), ("der hund und die katze", None)] * 3)]
    rows = [(i, t, None) for i, t in ODD] + [(7, "1234 !?", "en"), (8, "the dog", "x"), (9, "le chien " * 50_000, None)] + train
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", language.F.lit("z"))
    got = {r["doc_id"]: r for r in language.languages(docs, docs["doc_id"] >= 100, keep=["doc_id", "score"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 7, 8, 9)] == ["und", "und", "und", "en", "fr"] and got[1]["score"] == 0
    assert {r["lang_pred"] for r in got.values()} == {"und", "en", "fr"}
    assert {r["lang_pred"] for r in language.languages(docs, docs["doc_id"] < 0).collect()} == {"und"}
    assert language.languages(docs.limit(0), docs["doc_id"] > 0).count() == 0


def test_repetitive_words_differ(spark):
    """Words of one length whose polynomial hashes agree are not copies, and count apart."""
    for n in (1024, 4096):
        texts = [(1, thue_morse(n)), (2, thue_morse(n, True)), (3, thue_morse(n))]
        frame = spark.createDataFrame(texts, "doc_id long, text string")
        assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame).collect()} == {1: 1, 2: 2, 3: 1}
        scored = {r["doc_id"]: r["target_loss"] for r in lm_score.lm_scores(frame.withColumn("target", frame["doc_id"] < 3)).collect()}
        assert scored[1] != scored[3] and scored[1] == scored[2]


def test_minhash_several_texts(spark):
    """An id with several texts: each row follows its own text, the same in any order of rows."""
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, one), (5, two), (6, two), (7, one), (9, two)]
    found = [sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(x, "doc_id long, text string")).collect())) for x in (rows, rows[::-1])]
    assert found[0] == found[1] and {(6, 5), (7, 5), (9, 5)} <= {r[:2] for r in found[0]}


def test_many_hits_over_rounds(spark):
    """A million hit words, found in two rounds and more, take little time to merge."""
    a, b = [f"a{i}" for i in range(10)], [f"b{i}" for i in range(12)]
    one = " ".join([*a, "x", *b, *a[:5], "y"])
    docs = spark.createDataFrame([(1, one * 1), (2, f"{one} " * 45_000), (3, None), (4, " ".join(b + a + b[2:]))], "doc_id long, text string")
    bench = spark.createDataFrame([("p", " ".join(a)), ("q", " ".join(b)), ("r", " ".join(b[2:] + a[:5]))], "item_id string, text string")
    whole = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    began = time.time()
    parts = {r["doc_id"]: r for r in decontam.contamination(docs, bench, block_bytes=40, round_bytes=40).collect()}
    assert time.time() - began < 30
    assert parts == whole and whole[2]["n_hit"] == 45_000 * 27 and whole[4]["hit_spans"] == [0, 32] and whole[1]["items"] == ["p", "q", "r"]


def test_toxicity_behind_common_words(spark):
    """Two words whose exclusive-or is the label, rarer than 1,100 words that tell nothing."""
    rng = np.random.default_rng(12)
    filler = np.array([f"w{i}" for i in range(1100)])
    texts = []
    for i in range(3000):
        a, b = rng.random(2) < 0.35
        texts.append((i, " ".join([*filler[rng.random(1100) < 0.45], *["foo"] * int(a), *["bar"] * int(b)]), int(a ^ b)))
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int").repartition(8)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(df, df).collect()}
    out = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == texts[i][2] for i in out]) > 0.95


def test_joint_terms_in_slices(spark):
    """Pairs counted in slices of any size, against a matrix of all documents."""
    rng = np.random.default_rng(4)
    x = rng.random((600, 30)) < 0.3
    y = (x[:, 3] ^ x[:, 17]) | (rng.random(600) < 0.05)
    n, bad, count, toxic = 600, int(y.sum()), x.sum(0), x[y].sum(0)
    found = spark.createDataFrame([(int(b), [int(10 * t) for t in rng.permutation(np.flatnonzero(r))]) for r, b in zip(x, y, strict=True)], "__y int, terms array<int>").repartition(3)
    counts = spark.createDataFrame([(10 * t, int(count[t]), int(toxic[t])) for t in range(30)], "b int, c long, k long")
    want = set()
    for i in range(30):
        for j in range(i + 1, 30):
            both = x[:, i] & x[:, j]
            one = lambda v: np.array([v], float)
            g = toxicity.joint_gain(n, bad, (one(count[i]), one(count[j])), (one(toxic[i]), one(toxic[j])), one(both.sum()), one((both & y).sum()))
            if g[0] > 2 * math.log(450) + 10:
                want |= {10 * i, 10 * j}
    assert {30, 170} <= want
    for cells in (1, 100, 1 << 20):
        assert set(toxicity.joint_terms(found, counts, n, bad, 100, cells).tolist()) == want


def test_joint_terms_of_documents_without_any(spark):
    """Documents with no term, none that is common, or null terms are dealt to no slice."""
    told = [((i & 1) ^ (i >> 1 & 1), [10] * (i & 1) + [20] * (i >> 1 & 1) + [30] * (i % 3 == 0)) for i in range(400)]
    found = spark.createDataFrame([*told, *[(0, []), (1, None), (0, [5, 25])] * 5], "__y int, terms array<int>").repartition(3)
    counts = spark.createDataFrame([(10, 200, 100), (20, 200, 100), (30, 134, 67)], "b int, c long, k long")
    for cells in (1, 1 << 23):
        assert toxicity.joint_terms(found, counts, 415, 205, 100, cells).tolist() == [10, 20]


@pytest.mark.parametrize("size", [10, 1 << 24])
def test_items_without_id(spark, size):
    """Their windows are hit, in one round and in several, and the items are not named."""
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "d e"), (3, "q")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c"), (None, "d e"), (7, "b c"), (8, None), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in decontam.contamination(docs, bench, block_bytes=size, round_bytes=size).collect()}
    assert got == {1: (3, ["7"], True), 2: (2, [], True), 3: (0, [], False)}


def test_license_expressions_and_denials(spark):
    own = licenses.Templates()
    cases = [
        ("This is not released under the MIT License.", None, []),
        ("This isn't a joke. Released under the MIT License.", "MIT", ["MIT"]),
        ("No warranty\nReleased under the MIT License.", "MIT", ["MIT"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\nint x;", "MIT", ["Apache-2.0", "ISC", "MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0", ["GPL-2.0"]),
        ("SPDX-License-Identifier: LicenseRef-own", None, []),
        ("It was never licensed under CC BY 4.0. It is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", ["CC-BY-SA-4.0"]),
        ("Released under the MIT License. Parts are licensed under the Apache License, Version 2.0.", "MIT", ["Apache-2.0", "MIT"]),
    ]
    for text, name, found in cases:
        got = licenses.own_license(text, own)
        assert (got[0], [n for n, _ in got[3]]) == (name, found), text
    frame = spark.createDataFrame([(i, t, f"d/{i}.c", "z") for i, (t, _, _) in enumerate(cases)] + [(90, None, None, "z")], "doc_id long, text string, path string, found string")
    rows = {r["doc_id"]: r for r in licenses.licenses(frame, keep=["doc_id", "found"]).collect()}
    assert [(rows[i]["own_license"], [x["license"] for x in rows[i]["found"]]) for i in range(len(cases))] == [(n, f) for _, n, f in cases] and rows[90]["found"] == []
