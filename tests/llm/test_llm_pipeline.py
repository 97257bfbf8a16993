"""The pipeline stage by stage against brute force, and the registered queries."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from compare import connect, difference
from newstide.llm import queries, secrets
from newstide.llm.common import table
from newstide.llm.toxicity import score_toxicity
from newstide.sources import layout
from test_llm_dedup import brute_components, brute_fingerprint


def test_all_operators_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf_small, name):
    con = connect(sf_small)
    assert difference(spark, con, queries.QUERIES[name], queries.SQL[name], sf_small) is None
    con.close()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_covers_its_table(spark, sf_small, name):
    df = queries.QUERIES[name](spark, sf_small)
    name_of = {"op4": ("page_id", "pages"), "op12": ("vec_id", "embeddings"),
               "op13": ("vec_id", "embeddings")}
    key, source = name_of.get(name.split("_")[0], ("doc_id", "documents"))
    source = table(spark, sf_small, source)
    ids = sorted(r[0] for r in source.select(key).collect())
    got = sorted(r[0] for r in df.select(key).collect())
    assert (sorted(set(got)) if name.startswith("op7") else got) == ids


def test_stages(spark, sf_small, tmp_path):
    """Each stage on what the one before kept."""
    docs = table(spark, sf_small, "documents")
    kept = {r.doc_id: r.asDict() for r in docs.collect()}
    toxic = {r.doc_id for r in score_toxicity(docs, table(spark, sf_small, "labels")).collect()
             if r.toxic}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_small)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name == "toxicity":
            kept = {i: d for i, d in kept.items() if i not in toxic}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(kept, reverse=True):
                first[re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]["text"] or "")] = i
            kept = {i: kept[i] for i in first.values()}
        elif name == "simhash":
            group = brute_components({i: brute_fingerprint(d["text"]) for i, d in kept.items()})
            kept = {i: d for i, d in kept.items() if group[i] == i}
        elif name == "secrets":
            novelty = secrets.Novelty()
            for d in kept.values():
                d["text"] = secrets.redacted(d["text"], secrets.find_spans(d["text"], novelty)[1])
                d["n_chars"] = len(d["text"])
        if name == "packing":
            assert {r.doc_id for r in rows} == set(kept)
            assert sum(r.length for r in rows) == sum(
                len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) + 1 for d in kept.values())
        else:
            assert {r.doc_id: r.asDict() for r in rows} == kept, name


def test_run_equals_stages_and_handles_nothing(spark, sf_small):
    assert corpus_pipeline.run(spark, sf_small).count() > 0
    empty = table(spark, sf_small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_small).count() == 0


def test_nulls_pass_the_pipeline(spark, sf_small):
    docs = table(spark, sf_small, "documents").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0),
                                 (2, "", None, None, None), (3, "words to keep here", "en", "s", 18)],
                                docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, sf_small)
    assert {r.doc_id for r in odd.select("doc_id").collect()} >= {3}
    assert odd.agg(F.count("*")).first()[0] >= 2


def test_a_run_keeps_the_tables_of_its_last_stages_only(spark, sf_small):
    before = set(layout._TABLES)
    found = corpus_pipeline.run(spark, sf_small)
    left = [path.rsplit("/", 1)[1].split("-")[0] for path in set(layout._TABLES) - before]
    assert left.count("stage") == 1 and "fingerprints" not in left and "radix" not in left
    assert found.count() > 0
