"""The pipeline and the registered queries."""

import collections
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from slicewise.llm import jaccard, rules
from slicewise.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_a_query():
    names = [name for name in entry.queries() if name.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_copies", "mixture", "encode_tokens"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want


def test_stages(spark, sf_dir):
    text = " ".join(f"word{k} stands here as number {k}." for k in range(12))
    other = "Ein ganz anderer Text mit vielen eigenen Worten, der zu nichts sonst passt und lang genug ist, um zu bleiben."
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " end", "en", "b", 1), (3, other, "de", None, 1)]
    rows += [(None, text + " end", "en", "a", 1), (5, None, None, None, None), (6, "", "en", "a", 0), (7, "12 34 " * 30, "en", "a", 1)]
    rows += [(k, f"{other} {k} " + " ".join(f"u{k}x{j}" for j in range(30)), "de", "a", 1) for k in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
        kept = docs.collect()
        if name == "quality_rules":
            assert {5, 6, 7}.isdisjoint(r.doc_id for r in kept) and len(kept) == len(rows) - 3
        if name == "near_copies":
            assert [r.doc_id for r in kept if r.text.startswith("word0")].count(1) == 1
            assert {r.doc_id for r in kept} == {1, 3, *range(10, 30)}
        docs = spark.createDataFrame(kept, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == docs.count() and all(len(r.ids) == r.n_tokens for r in last)


def test_near_copies_with_repeated_and_missing_ids(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, b), (7, b), (7, a), (7, a), (None, c), (None, c), (None, a), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs.repartition(3), sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(3, b), (7, a), (None, c), (9, None)], key=str)


def test_stages_of_no_rows(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run_against_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in rules.ledger(docs).where(rules.passes(rules.POLICY)).select("doc_id").collect()}
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()
    groups = jaccard.near_copies(docs.where(F.col("doc_id").isin(*good))).collect()
    assert sorted(r.doc_id for r in found) == sorted({r.component_id for r in groups})


def test_rows_of_a_run_say_their_place_in_the_mixture(spark, tmp_path, sf_dir):
    other = "Ein ganz anderer Text mit vielen eigenen Worten, der zu nichts sonst passt und lang genug ist, um zu bleiben."
    sources = ["hot"] * 400 + ["a"] * 100 + [None] * 100
    rows = [(k, f"{other} {k} " + " ".join(f"u{k}x{j}" for j in range(30)), "de", s, 1) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "phase", "slot", "place").collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    assert len({(r.slot, r.place) for r in got}) == 600
    slots = {r.slot: r.source for r in got if r.phase == 0}
    assert sorted(slots) == list(range(len(slots))) and len(slots) >= 20
    done = collections.Counter()
    for t in range(len(slots)):
        done[slots[t]] += 1
        for source, weight in {"hot": 0.5, "a": 0.25, None: 0.25}.items():
            assert abs(done[source] - weight * (t + 1)) < 1


def test_near_copies_of_five_words_and_four_fifths(spark, sf_dir):
    def texts(n, changed):
        base = [f"w{n}x{k}" for k in range(84)]
        return [" ".join(base), " ".join([*base[:-changed], *[f"v{n}x{k}" for k in range(changed)]])]

    rows = [(2 * n + j, t) for n, changed in enumerate([1, 4, 7, 8, 9, 10, 20]) for j, t in enumerate(texts(n, changed))]
    # changes inside a text: five words take five shingles of five words each
    rows += [(100 + k, " ".join(f"z{j if (j + 3) % 42 or not k else -j}" for j in range(84))) for k in range(2)]
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    gone = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            gone.add(b)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(sets) - gone) and {1, 3, 5, 7} <= gone
    assert not {11, 13} & gone
