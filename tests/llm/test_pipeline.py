"""The pipeline as a whole: odd input, and what it leaves behind."""

import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoloom.llm import common, packing, registry, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def key(spark):
    """One key for all runs, which makes their pseudonyms comparable."""
    spark.conf.set("spark.chronoloom.pii.key", "of the tests")
    yield
    spark.conf.unset("spark.chronoloom.pii.key")


def _copy(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    common.table(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_"))}


def _texts(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        out.setdefault(r["doc_id"], []).append(r["ids"])
    return out


def test_only_the_results_tables_stay(spark):
    folder = common.shared_folder(spark).removeprefix("file:")
    before = _files(folder)
    out = corpus_pipeline.run(spark, SF)
    left = _files(folder) - before
    rows = out.collect()
    assert rows and left
    # What is left is the checkpoint of the pieces and the counts of their lengths: about their ids, half as wide.
    assert sum(map(os.path.getsize, left)) < 1.2 * sum(len(r.ids) for r in rows) + 200_000
    spark.createDataFrame([(1,)], "a int").count()
    assert len(out.collect()) == len(rows)


def _shuffled(spark):
    """Shuffle files on this machine and their bytes."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f: os.path.getsize(f) for top in manager.localDirsString() for f in _files(top) if "/shuffle_" in f}


def test_the_near_stage_frees_its_disk(spark):
    """No shuffle file of its steps stays, documents that are no copies are not shuffled, and of its tables the large ones go."""
    docs = common.durable(common.table(spark, SF, "documents"))
    size = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    folder = common.shared_folder(spark).removeprefix("file:")
    files, tables, before = _shuffled(spark), _files(folder), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near(spark, docs, SF)
        left = sum(n for f, n in _shuffled(spark).items() if f not in files)
        ids = [r.doc_id for r in out.collect()]
        last = sum(n for f, n in _shuffled(spark).items() if f not in files)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids and left < 0.02 * size and last < 0.2 * size
    # The ids, fingerprints and keys of all rows would be as much again as they are without keys.
    assert sum(map(os.path.getsize, _files(folder) - tables)) < 0.6 * size


def test_only_blocks_over_a_chunk_are_dealt_twice(spark):
    """A block whose rows differ from its pivot doesn't move the small blocks' rows a second time."""
    words = np.random.default_rng(3).integers(0, 1 << 63, (4000, 64), "u8")
    rows = [(i // 2, 2, i, words[i // 2].tobytes()) for i in range(4000)] + [(-1, 20, 5000 + i, words[i // 2].tobytes()) for i in range(20)]
    blocks = common.durable(spark.createDataFrame(rows, "key long, n long, node long, data binary"))
    files, before = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = {(min(r), max(r)) for r in simhash.linked(blocks, 8, simhash.similar_sets(0.8, "cosine")).collect() if r.u != r.v}
        moved = sum(n for f, n in _shuffled(spark).items() if f not in files)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert links == {(i, i + 1) for i in range(0, 4000, 2)} | {(5000 + i, 5001 + i) for i in range(0, 20, 2)}
    assert moved < 0.2 * 4000 * 512


def test_durable_leaves_no_shuffle_files(spark):
    before = set(_shuffled(spark))
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    assert common.durable(df).count() == df.count() == 100 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    names = {os.path.basename(f).split("_")[1] for f in set(_shuffled(spark)) - before}
    assert len(names) <= 3  # of both counts, and of ``df`` itself


def test_released_tables_are_gone(spark):
    with common.noted() as made:
        a, b = common.durable(spark.range(10)), common.durable(spark.range(20))
    common.released(a)
    assert [os.path.exists(p.removeprefix("file:")) for p in made] == [False, True] and b.count() == 20
    common.released(a)


def test_noted_folders_can_be_removed(spark):
    with common.noted() as made:
        df = registry.op3_quality_rules(spark, "/root/testdata/sf0.001")
        assert df.count() == 200
    assert made and all(os.path.exists(p.removeprefix("file:")) for p in made)
    common.removed(spark, made)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in made)
    common.removed(spark, made)


def test_an_empty_table(spark, tmp_path):
    docs = common.table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.run(spark, _copy(spark, tmp_path, docs)).count() == 0


def test_null_repeated_and_clashing_rows(spark, tmp_path):
    """Columns named like the operators' own, null ids and texts, rows brought twice, one very long text."""
    docs = common.table(spark, SF, "documents").limit(300)
    names = ("_row", "kept", "fp", "size", "id", "k", "h", "text_sha256", "component_id", "piece", "length", "ids", "part", "uid")
    clash = {c: F.lit(f"x{n}") for n, c in enumerate(names)}
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000))
    odd = spark.createDataFrame([(None, None), (None, ""), (900_001, None), (900_002, long), (900_002, long), (None, "only blanks \t "), (900_003, long + " end")], "doc_id long, text string")
    plain = corpus_pipeline.run(spark, _copy(spark, tmp_path / "a", docs)).collect()
    whole = docs.unionByName(docs.limit(40)).unionByName(odd, allowMissingColumns=True).withColumns(clash)
    got = corpus_pipeline.run(spark, _copy(spark, tmp_path / "b", whole)).collect()
    more = _texts(got)
    # The forest has seen other rows, so a document at its threshold may be judged anew; all others come out alike.
    both, alone = {k: v for k, v in more.items() if k is not None and k < 900_000}, _texts(plain)
    assert len(both.keys() ^ alone.keys()) <= 3 and all(both[k] == alone[k] for k in both.keys() & alone.keys())
    assert None not in more and 900_001 not in more
    assert len({k for k in more if k >= 900_000}) <= 1


@pytest.mark.parametrize("name", ["quality", "exact", "near", "private"])
def test_stages_return_the_columns_of_documents(spark, name):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").withColumn("extra", F.struct("doc_id"))
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_packed_ids_are_the_pseudonymised_texts(spark):
    """The last stage's ids, read back by the tokenizer, are those of the stage before."""
    docs = corpus_pipeline.private(spark, common.table(spark, "/root/testdata/sf0.001", "documents"), "/root/testdata/sf0.001")
    docs = common.durable(docs)
    ids = _texts(corpus_pipeline.packed(spark, docs, "").collect())
    encode = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))._tokenizer
    for r in docs.collect():
        assert b"".join(ids[r.doc_id]) == np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
