"""Each stage of a run of the pipeline against brute force on what its predecessor kept."""

from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import toxicity
from test_contracts import ROWS, check_packing, kept_exactly, kept_nearly, mixed, table

TOXIC = " ".join(["you horrible monster go away"] * 3)


def corpus():
    rows = [(1000 + i, f"plain words number {i} about nothing in particular " + " ".join(f"t{i * 7 % 60} t{(i * 7 + j) % 60} u{j}" for j in range(i % 40)) + (TOXIC if i % 9 == 0 else ""), "en", "abc"[i % 3]) for i in range(240)]
    rows += [(2000 + i, rows[i][1].replace(" ", "  "), "en", "c") for i in range(1, 40, 3)]  # exact copies
    rows += [(3000 + i, rows[i][1] + " end", "en", "b") for i in range(30, 39)]  # near ones
    return [r for r in ROWS if r[0] is not None] + rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    table(spark, corpus()).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 9 == 0)) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_each_stage_and_the_whole(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pack" or docs.columns == columns

    scores = {r.doc_id: r.predicted for r in toxicity.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    clean = rows_of(kept["toxicity"])
    assert Counter(clean) == Counter(r for r in corpus() if not scores[r[0]])
    assert all((r[0] - 1000) % 9 for r in clean if 1000 <= r[0] < 2000) and len(clean) > 200
    different = rows_of(kept["exact_dedup"])
    assert Counter(different) == kept_exactly(clean) and len(different) < len(clean)
    apart = rows_of(kept["near_dedup"])
    assert Counter(apart) == kept_nearly(different, 5, 80) and len(apart) < len(different)
    _, times, _, _ = mixed(apart, False)
    expected = Counter()
    for i, r in enumerate(apart):
        expected[r] += times[i]
    assert Counter(rows_of(kept["mix_sources"])) == +expected
    check_packing(kept["pack"].collect(), rows_of(kept["mix_sources"]))

    whole = corpus_pipeline.run(spark, sf_dir)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(whole.select(*names).collect()) == Counter(kept["pack"].select(*names).collect())
