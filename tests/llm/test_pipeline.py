"""Each stage on what its predecessor kept, against what its operator says."""

import base64
import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkvision.llm import queries
from sparkvision.llm.scratch import written

from .conftest import SCHEMA, prose
from .test_joins import shingles
from .test_repeats import brute_bytes


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split(" ")[0])
        assert docs.columns == columns and docs.schema == seen[0].schema
        seen.append(docs)
    n = [d.count() for d in seen]
    assert n[0] >= n[1] >= n[2] >= n[3] == n[4] > 0

    kept = {r.doc_id: r.text for r in seen[3].collect()}
    before = {r.doc_id: r.text for r in seen[2].collect()}
    sets = {i: shingles(t) for i, t in kept.items()}
    ids = sorted(kept)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            assert not (a & b) or len(a & b) / len(a | b) < 0.8
    for i in set(before) - set(kept):
        a = shingles(before[i])
        assert any(j != i and len(a & shingles(t)) / max(1, len(a | shingles(t))) >= 0.8 for j, t in before.items())

    want = {r[0]: r[1] - r[2] for r in brute_bytes([(i, t) for i, t in kept.items()], pipeline.PASSAGE)}
    for r in seen[4].collect():
        assert 0 <= want[r.doc_id] - len(r.text.encode()) <= 8 and r.n_chars == len(r.text)

    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n[4]


def test_no_learned_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(8)
    junk = [
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)),
        "".join(rng.choice("asdfghjkl") for _ in range(120)),
        rng.randbytes(90).hex(),
        base64.b64encode(rng.randbytes(90)).decode(),
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    ]
    rows = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(junk)], docs.schema)
    got = {r.doc_id for r in pipeline.language_id(spark, docs.unionByName(rows), sf_dir).collect()}
    clean = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(docs.where("text IS NOT NULL"), "doc_id").collect()
    assert not [i for i in got if i < 0] and {r.doc_id for r in clean} <= got


def test_near_copies_without_or_with_shared_ids(spark, sf_dir):
    rng = random.Random(9)

    def near(text, at):
        words = text.split(" ")
        words[at] = "changed"
        return " ".join(words)

    nameless, mixed, shared, alone = (prose(rng, 200) for _ in range(4))
    rows = [(None, nameless), (None, near(nameless, 50)), (None, near(nameless, 120)), (1, mixed), (None, near(mixed, 70)), (2, shared), (2, near(shared, 90)), (3, near(shared, 20)), (2, alone), (2, alone)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in pipeline.ngram_jaccard_join(spark, docs, sf_dir).collect()]
    family = [nameless, mixed, shared, alone]
    said = sorted(((next(k for k, t in enumerate(family) if len(shingles(t) & shingles(x)) > 100), i) for i, x in got), key=str)
    assert said == [(0, None), (1, 1), (2, 2), (3, 2)]


def test_passages_of_over_fifty_words_go(spark, sf_dir):
    """Of 51 words and more, fewer than 400 bytes among them, each in three otherwise different documents."""
    rng = random.Random(10)
    passages = [prose(rng, rng.randint(51, 60)) for _ in range(20)]
    rows = [(100 * k + i, f"{prose(rng, 80)} {p} {prose(rng, 60)}") for k, p in enumerate(passages) for i in range(3)]
    clean = [(5000 + i, prose(rng, 150)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + clean], SCHEMA)
    got = {r.doc_id: r.text for r in pipeline.suffix_array_dedup(spark, docs, sf_dir).collect()}
    assert min(len(p) for p in passages) < 400
    assert not any(passages[i // 100] in got[i] for i, _ in rows)
    assert all(len(t) - len(got[i]) <= len(passages[i // 100]) + 20 for i, t in rows)
    assert all(got[i] == t for i, t in clean)


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0


def test_extra_columns_and_no_rows(spark, sf_dir, odd, none):
    for docs in (odd, none):
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), name.split(" ")[0])
    assert docs.count() == 0


def test_queries_on_the_smallest_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    other = {"op11_hard_negatives": ("anchor_id", vectors.where("vec_id % 100 = 0").count()), "op12_embedding_whitening": ("vec_id", vectors.count())}
    for name, f in queries.QUERIES.items():
        column, want = other.get(name, ("doc_id", n))
        assert f(spark, sf_dir).select(F.col(column)).distinct().count() == want, name


def test_counts_equal_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        want = con.execute(sql).fetchall()
        names = [d[0] for d in con.description]
        got = [tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, sf_dir).collect()]
        assert sorted(got) == sorted(want), name
