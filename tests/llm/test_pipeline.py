"""The stages of the pipeline on the small tables, each against what its operator promises."""

import os
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from trackline.llm import bagminhash, line_dedup, mixing, quality_rules
from trackline.llm.oracle import ORACLE_SQL
from trackline.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    want = sorted(str(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


def test_stages(spark, stored):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = stored
    rules = corpus_pipeline.rules_stage(spark, docs, "")
    verdict = defaultdict(list)
    for r in quality_rules.assess(docs).collect():
        verdict[r.doc_id].append(r)
    assert sorted(r.doc_id or -1 for r in rules.collect()) == sorted(
        (k or -1) for k, found in verdict.items() for r in found if r.kept
    )
    assert {(r.doc_id, r.text) for r in rules.collect()} == {(k, r.cleaned) for k, f in verdict.items() for r in f if r.kept}
    lines = corpus_pipeline.lines_stage(spark, rules, "")
    assert lines.count() == rules.count()
    assert sum(r.n_removed for r in line_dedup.clean(rules).collect()) > 0
    near = corpus_pipeline.near_stage(spark, lines, "")
    classes = {r.class_id for r in bagminhash.near_duplicates(lines).collect()}
    assert sorted(r.doc_id or -1 for r in near.collect()) == sorted(c or -1 for c in classes)
    mixed = corpus_pipeline.mix_stage(spark, near, "")
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.mix(near).collect())
    for stage in (rules, lines, near, mixed):
        assert stage.dtypes == docs.dtypes
    packed = corpus_pipeline.pack_stage(spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


@needs_tables
def test_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A run whose fourth stage fails does not compute the first three again."""
    calls, stages = [], corpus_pipeline.STAGES

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if name == "mixing" and calls.count(name) == 1:
                raise RuntimeError("cut off")
            return stage(spark, docs, sf_dir)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF_DIR, str(tmp_path))
    assert corpus_pipeline.run(spark, SF_DIR, str(tmp_path)).count() > 500
    assert calls == ["quality_rules", "line_dedup", "near_dedup", "mixing", "mixing", "packing"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, nothing, tmp_path, name, stage):
    nothing.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    assert stage(spark, docs, "").count() == 0


@needs_tables
def test_run(spark):
    """Whole result: no sequence is longer than its limit."""
    pieces = corpus_pipeline.run(spark, SF_DIR)
    assert pieces.count() > 500
    ends = pieces.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert max(r["sum(length)"] for r in ends) <= 4096
