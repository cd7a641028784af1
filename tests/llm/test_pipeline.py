"""The corpus pipeline against brute force, stage by stage and as a whole."""

import os

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from mercantile.llm import packing
from mercantile.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import classes_of, words


def contaminated(text, items):
    w = words(text)
    return any(tuple(w[k : k + n]) in items for n in {len(x) for x in items} for k in range(len(w) - n + 1))


def masked(text, spans):
    """spans: kind:start:end, by start, comma-joined."""
    out, at = [], 0
    for s in filter(None, spans.split(",")):
        _, a, b = s.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], "[SECRET]"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def with_secrets(spark, sf_dir, tmp_path):
    """The small tables, with copies of every fifth document into which secrets are put, a word apart
    so often that they are no near copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    secrets = ["password = hunter22x", "AKIA" + "Q7" * 10, "0f" * 16, "q9Xz7Lm2Vb8Nc4Rt6Yw1Kp3Hd5Js0Gf"]
    more = []
    for r in docs.where("doc_id % 5 = 0").collect():
        w = (r["text"] or "").split(" ")
        for k in range(0, len(w), 4):
            w[k] += " " + secrets[k // 4 % 4] if k % 16 == 0 else f" x{r['doc_id']}y"
        more.append((r["doc_id"] + 1_000_000, " ".join(w), r["lang"], r["source"], 0))
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_whole(spark, sf_dir, tmp_path):
    sf_dir = with_secrets(spark, sf_dir, tmp_path)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in QUERIES["op3_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    kept = {i: t for i, t in texts.items() if i not in toxic}
    label = classes_of(kept.items())
    kept = {i: t for i, t in kept.items() if label[i] == i}
    items = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        items |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    kept = {i: t for i, t in kept.items() if not contaminated(t, items)}
    assert 0 < len(kept) < len(texts)
    spans = {r["doc_id"]: r["spans"] for r in QUERIES["op1_secret_scan"](spark, sf_dir).collect()}
    clean = {i: masked(t, spans[i]) for i, t in kept.items()}
    assert sum(clean[i] != kept[i] for i in kept) > 5
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in clean.items()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    have, place = {}, []
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = have.setdefault(p["doc_id"], [])
        assert p["start"] == len(own) and p["length"] == len(p["ids"])
        own += p["ids"]
        place.append((p["sequence_id"] * 2048 + p["offset"], p["length"]))
    assert have == want
    place.sort()
    assert [a for a, _ in place] == np.cumsum([0, *(n for _, n in place)])[:-1].tolist()


def odd(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en"), (1, base, "en"), (2, base.upper(), "de"), (3, base.replace("w30", "other"), "en"), (4, "quite different words stand here today", "en"), (5, None, None), (6, "", "en"), (None, base, None), (None, base, None)]
    return spark.createDataFrame([(*r, "s", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")


def test_near_duplicates_stage(spark, sf_dir):
    got = corpus_pipeline.drop_near_duplicates(spark, odd(spark), sf_dir)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "4", "5", "6", "None", "None"]


def test_stages_on_odd_and_empty_rows(spark, sf_dir):
    docs, none = odd(spark), odd(spark).where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, sf_dir), stage(spark, none, sf_dir)
        assert docs.columns == none.columns == corpus_pipeline.COLUMNS and none.isEmpty()
    assert corpus_pipeline.pack(spark, docs, sf_dir).where("start = 0").count() == docs.count() == 6
    assert corpus_pipeline.pack(spark, none, sf_dir).isEmpty()


def test_toxicity_stage_of_documents_without_common_terms(spark, sf_dir):
    """Some documents of sf0.01 hold no term that is common enough to be paired."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, big)
    assert 0 < kept.count() < docs.count() and kept.columns == corpus_pipeline.COLUMNS


def test_pipeline_on_documents_without_common_terms(spark, tmp_path):
    """Labelled documents whose words nobody else has go through all stages and are kept."""
    shared = [(i, f"{'alpha ' * (i & 1)}{'beta ' * (i >> 1 & 1)}word{i}x own{i}y", (i & 1) ^ (i >> 1 & 1)) for i in range(400)]
    alone = [(1000 + i, f"q{i}z k{i}w j{i}v", 0) for i in range(40)] + [(2000, "", 0), (2001, None, 0)]
    rows = shared + alone
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "ten words of a passage that no document holds here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {1000 + i for i in range(40)} <= packed <= {i for i, _, _ in rows}


def test_pipeline_equals_sql_where_there_is_some(spark, sf_dir):
    """On sf0.01: what toxicity leaves goes through the SQL of near duplicates and of decontamination, in
    DuckDB; the ids of what is left, masked by op1's spans, are those of the pipeline."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    clean = [r["doc_id"] for r in QUERIES["op3_toxicity"](spark, big).where("predicted = 0").collect()]
    con = duckdb.connect()
    con.register("clean", pa.table({"doc_id": pa.array(clean, pa.int64())}))
    con.execute(f"create view benchmark as select * from '{big}/benchmark.parquet'")
    con.execute(f"create table documents as select * from '{big}/documents.parquet' where doc_id in (select doc_id from clean)")
    for name, kept in (("op9_minhash_near_dedup", "kept"), ("op2_decontamination", "not contaminated")):
        before = con.execute("select count(*) from documents").fetchone()[0]
        con.execute(f"create table left_over as select doc_id from ({ORACLE_SQL[name]}) where {kept}")
        con.execute("delete from documents where doc_id not in (select doc_id from left_over)")
        con.execute("drop table left_over")
        assert 0 < con.execute("select count(*) from documents").fetchone()[0] < before
    spans = {r["doc_id"]: r["spans"] for r in QUERIES["op1_secret_scan"](spark, big).select("doc_id", "spans").collect()}
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = {i: [*tokenizer.encode(masked(t or "", spans[i]), add_special_tokens=False).ids, packing.END_ID] for i, t in con.execute("select doc_id, text from documents").fetchall()}
    have = {}
    for p in sorted(corpus_pipeline.run(spark, big).select("doc_id", "start", "ids").collect()):
        have.setdefault(p["doc_id"], []).extend(p["ids"])
    assert have == want
