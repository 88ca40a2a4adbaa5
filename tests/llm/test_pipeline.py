from collections import Counter

import pytest

import corpus_pipeline
from ledgerline.llm import queries
from ledgerline.llm.common import table, written

from ..compare import rows, tables
from .test_dedup import kept_lines
from .test_native import by_hand

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), tables(sf_dir).execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    good = written(STAGES["quality"](spark, docs, sf_dir), "q")
    assert not any(by_hand(r["text"])[-1] for r in good.collect())
    deduped = written(STAGES["lines"](spark, good, sf_dir), "l")
    want = kept_lines([(r["doc_id"], r["text"]) for r in good.collect()])
    assert Counter((r["doc_id"], r["text"]) for r in deduped.collect()) == Counter((i, t) for i, _, _, t in want)
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())
    single = written(STAGES["near_duplicates"](spark, deduped, sf_dir), "n")
    assert {r["doc_id"] for r in single.collect()} <= {r["doc_id"] for r in deduped.collect()}
    cut = written(STAGES["passages"](spark, single, sf_dir), "p")
    assert good.columns == deduped.columns == single.columns == cut.columns == columns
    assert cut.count() == single.count()
    packed = STAGES["packing"](spark, cut, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in cut.collect()}


def test_run_takes_odd_rows(spark, odd, tmp_path):
    docs = odd.selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "cast(null as bigint) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs.filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
