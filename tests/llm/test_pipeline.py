import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from test_decontaminate import brute as contaminated  # noqa: E402
from test_mixing import targets  # noqa: E402
from test_quality import brute as statistics  # noqa: E402
from test_simhash import expected as near_copies  # noqa: E402

from corpusflow.llm import mixing, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    """The odd documents with ids that stand once, a benchmark and labels, as tables."""
    path = tmp_path_factory.mktemp("tables")
    ids = [r[0] for r in rows]
    own = [r for r in rows if ids.count(r[0]) == 1 and r[0] is not None]
    spark.createDataFrame(own, SCHEMA).write.parquet(f"{path}/documents.parquet")
    item = " ".join(own[8][1].split()[2:14])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), own, [(1, item), (2, None)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_each_stage_by_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_copies", "decontamination", "mixing", "sharding"]

    _, rules = quality.learn_from(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert rules == []  # all labels are good
    rows = [r for r in rows if not statistics(r[1])[5]]
    docs = stages["quality_rules"](spark, docs, path)
    assert rows_of(docs) == sorted(rows, key=str)

    stay = {c for _, _, c in near_copies(rows)}
    rows = [r for r in rows if r[0] in stay]
    docs = stages["near_copies"](spark, docs, path)
    assert rows_of(docs) == sorted(rows, key=str)

    bad = {r[0] for r in contaminated(rows, items) if r[5]}
    assert bad == {folder[1][8][0]}
    rows = [r for r in rows if r[0] not in bad]
    docs = stages["decontamination"](spark, docs, path)
    assert rows_of(docs) == sorted(rows, key=str)

    sizes, size = {}, {}
    for r in rows:
        size[r[0]] = len(r[1].split())
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    docs = stages["mixing"](spark, docs, path)
    taken = {}
    for r in docs.collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for source, target in targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= max(size.values())
    assert set(rows_of(docs)) <= set(rows)

    done = stages["sharding"](spark, docs, path)
    assert rows_of(done) == rows_of(docs)
    assert done.filter("shard < 0 OR shard > 7 OR NOT grown_shard IN (shard, 8)").count() == 0


def test_run_and_repeat(spark, folder):
    path, rows, _ = folder
    one, two = (corpus_pipeline.run(spark, path) for _ in range(2))
    assert rows_of(one) == rows_of(two) and one.count() > 0
    assert {r[0] for r in rows_of(one)} <= {r[0] for r in rows}
    assert one.columns == [*corpus_pipeline.COLUMNS, "shard", "grown_shard"]


def test_odd_and_empty_tables(spark, documents, nothing, folder):
    path, _, _ = folder
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, documents, path)
        assert kept.columns[:5] == corpus_pipeline.COLUMNS and kept.count() <= 3 * documents.count(), name
        assert stage(spark, nothing, path).count() == 0, name


def test_the_mix_reruns_alike(documents):
    assert rows_of(mixing.mix_documents(documents)) == rows_of(mixing.mix_documents(documents.repartition(9)))
