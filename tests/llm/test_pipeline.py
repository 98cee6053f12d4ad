import json
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from foliospark.llm import mixing, quality, secrets, simhash
from foliospark.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "secret_scan", "mix_sources", "bpe_encode"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows[name] = docs.collect()
        if name != "bpe_encode":
            assert docs.columns == first.columns
            docs = spark.createDataFrame(rows[name], docs.schema)
    kept = {r.doc_id for r in quality.quality_report(first).where("kept").collect()}
    assert {r.doc_id for r in rows["quality_rules"]} == kept
    survivors = spark.createDataFrame(rows["quality_rules"], first.schema)
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(survivors).collect()}
    assert sorted(r.doc_id for r in rows["simhash_dedup"]) == sorted(set(groups.values()))
    assert {r.doc_id for r in rows["secret_scan"]} == {r.doc_id for r in rows["simhash_dedup"]} == {r.doc_id for r in rows["bpe_encode"]}
    assert secrets.secret_report(spark.createDataFrame(rows["secret_scan"], first.schema)).where("n_assign + n_access + n_hex > 0").count() == 0
    assert all(r.decodes for r in rows["bpe_encode"])
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: r.n_tokens for r in rows["bpe_encode"]}


def test_order_reaches_the_result(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").repartition(7)
    placed = mixing.mixed(docs)
    want = [r.doc_id for r in placed.orderBy(placed.columns[-1]).collect()]
    stored = written(corpus_pipeline.mix_sources(spark, docs, sf), "mixed")
    rows = written(corpus_pipeline.bpe_encode(spark, stored, sf).repartition(5), "encoded").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.mix_pos)] == want
    assert len({r.mix_pos for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(__import__("foliospark.llm.queries", fromlist=["x"]).oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = sorted(json.dumps(dict(zip(columns, r)), sort_keys=True) for r in want.fetchall())
    got = sorted(json.dumps(r.asDict(), sort_keys=True) for r in __spark_entry__.queries()[name](spark, sf).collect())
    assert got == want


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_dedup_stage_against_all_pairs(spark, sf):
    """What stays is the smallest id of each group over links at an exact similarity of 0.8 or more, and nothing else."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, shingles(r.text)) for r in docs.collect())
    part = {k: k for k, _ in rows}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            common = len(a & b)
            if a == b or common and 10 * common >= 8 * (len(a) + len(b) - common):
                low, high = sorted((root(i), root(j)))
                part[high] = low
    want = sorted(k for k, _ in rows if root(k) == k)
    assert len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()) == want


EDGES = [
    (None, None, None, None, None, "x"), (1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, None), (2, "", None, "a", 0, None), (3, " \n\t ", "en", None, 3, "x"),
    (4, "one two three " * 3, "en", "a", 42, "y"), (5, " ".join(f"w{k}" for k in range(120)), "en", "b", None, "y"), (6, " ".join(f"w{k}" for k in range(120)), "en", "b", 1, "z"),
    (None, " ".join(f"v{k}" for k in range(90)), "fr", None, 1, "z"), (7, " ".join(f"u{k % 50000}" for k in range(60000)), "en", "c", 1, "z"), (8, "password=abcdefgh12 " + " ".join(f"t{k}" for k in range(80)), "de", "a", 5, "z"),
]


@pytest.mark.parametrize("n_rows", [len(EDGES), 0])
def test_stages_on_odd_rows(spark, sf, n_rows):
    """Nulls in every column, empty and long texts, repeated rows, no rows, and columns named like those of the operators."""
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, work string"
    docs = spark.createDataFrame(EDGES[:n_rows], names).selectExpr("*", "work AS mix_pos", "work AS bucket", "work AS base_spans", "work AS secret_spans", "work AS measures", "work AS keep", "work AS key", "work AS mark")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([5, 6, None, 7, 8] if n_rows else [])
    single = corpus_pipeline.simhash_dedup(spark, docs, sf)
    assert single.columns == docs.columns
    assert Counter(r.doc_id for r in single.collect()) == Counter([1, 4, 5, None, 7, 8] if n_rows else [])
    clean = corpus_pipeline.secret_scan(spark, docs, sf)
    assert clean.columns == docs.columns
    before, after = ({(r.doc_id, (r.text or "")[:30]): r for r in x.collect()} for x in (docs, clean))
    changed = [r for k, r in after.items() if k not in before or before[k] != r]
    assert [(r.doc_id, r.text[:17], r.n_chars) for r in changed] == ([(8, "[secret] t0 t1 t2", len(changed[0].text))] if n_rows else [])
    order = corpus_pipeline.mix_sources(spark, docs, sf)
    assert order.columns == docs.columns
    assert Counter(map(str, order.collect())) == Counter(map(str, docs.collect()))
    ids = corpus_pipeline.bpe_encode(spark, docs.drop("mix_pos"), sf).collect()
    assert Counter(r.doc_id for r in ids) == Counter(r[0] for r in EDGES[:n_rows]) and all(r.decodes for r in ids)
    assert all((r.n_tokens == 0) == (not r.doc_id or r.doc_id < 3) for r in ids if r.doc_id)
