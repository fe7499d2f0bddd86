"""The pipeline stage by stage against plain versions, and its queries against their check SQL."""

import importlib
import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from burnish.llm import language  # noqa: E402
from burnish.llm.common import DOCUMENT_COLUMNS  # noqa: E402
from burnish.llm.queries import CHECK_SQL  # noqa: E402
from tests.llm.test_operators import WORD, plain_components, plain_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results.append(docs.toPandas())
    told, first, cut, mixed, packed = results
    source = pq.read_table(f"{SF}/documents.parquet").to_pandas()

    rejected = {r.doc_id for r in language.languages(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.rejected}
    assert sorted(told.doc_id) == sorted(set(source.doc_id) - rejected) and len(rejected) < 0.05 * len(source)
    classes = plain_components([(int(d), plain_fingerprint(t)) for d, t in zip(told.doc_id, told.text, strict=True)])
    assert sorted(first.doc_id) == sorted(set(classes.values()))
    assert set(cut.doc_id) <= set(first.doc_id)
    # Every five-word shingle of a text that was cut stands in a text that is left, or held an edited word.
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 4)}
    left = set().union(*map(shingles, cut.text))
    before = dict(zip(first.doc_id, first.text, strict=True))
    gone = [s for i, t in before.items() for s in shingles(t) - left]
    assert len(gone) < 0.02 * sum(len(shingles(t)) for t in before.values())
    assert (cut.text.str.len() == cut.n_chars).all()
    for frame in (told, first, cut, mixed):
        assert tuple(frame.columns) == DOCUMENT_COLUMNS
    assert set(mixed.doc_id) <= set(cut.doc_id) and mixed.doc_id.value_counts().max() <= 3
    assert len(packed.query("piece == 0")) == len(mixed)
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark):
    run = corpus_pipeline.run(spark, SF)
    assert run.count() > 0 and importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", list(CHECK_SQL))
def test_check_sql(spark, name):
    from tools.verify import compare

    engine = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    status, _, _, detail = compare(spark, engine, name, SF)
    assert status == "ok", detail


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Each stage by itself on nulls, empty and long texts, repeated rows and clashing names, and on no rows."""
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, SF)
        rows = made.collect()
        assert stage(spark, empty, SF).count() == 0, name
        if name == "packing":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
            continue
        assert tuple(made.columns) == DOCUMENT_COLUMNS, name
        ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
        if name == "near_duplicates":
            assert ids[0] == 1 and len(ids) == len(set(ids)) and not {3, 4, 7} & set(ids)  # 2, 3 and 4 share a fingerprint, 5 and 7 a text
        elif name == "repeated_passages":
            assert ids == [1, 1, 2, 5, 6]  # 7 repeats 5; 3 and 4 hold no word
        else:
            assert set(ids) <= {1, 2, 3, 4, 5, 6, 7}
