"""Row numbers that do not depend on how files are dealt out; packing on either side of its bounds."""

import random

import pytest
from pyspark.sql import functions as F

from review_insights.llm import common, packing
from tests.llm import brute


def test_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 3000, 1, 5).select("id", F.repeat(F.lit("x"), 200).alias("_metadata"), F.lit("y").alias("_at_file"))
    df.write.option("parquet.block.size", 20_000).parquet(path)
    found, before = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128MB", "10KB"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = common.numbered(spark.read.parquet(path), "row")
            assert rows.columns == ["id", "_metadata", "_at_file", "row"]
            found.append({r["id"]: r["row"] for r in rows.select("id", "row").collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len(set(found[0].values())) == 3000


@pytest.fixture(scope="module")
def ids_of():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [1, 5, 8_192])
def test_open_windows_are_bounded(spark, monkeypatch, ids_of, most):
    """Lengths that never fit together: every id once, no padding, also when windows are closed early."""
    monkeypatch.setattr(packing, "MAX_OPEN", most)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(33, 40)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    padding, _ = brute.check_pieces(packing.pack(df, capacity=64).collect(), rows, ids_of, 64)
    assert padding == 0


def test_texts_on_either_side_of_the_library_switch(monkeypatch, ids_of):
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    encoder = packing.Encoder(*packing.default_paths())
    rng = random.Random(2)
    for n in (0, 49, 50, 51, 400):
        for _ in range(30):
            text = "".join(rng.choice(["a", "B ", "é", "中", "\n\n", "  ", "'s", "<|endoftext|>", "1", "🙂"]) for _ in range(n))[:n]
            assert encoder.ids(text).tolist() == ids_of(text)


def test_frames_that_are_no_scan_are_written_first(spark):
    rows = common.numbered(spark.range(0, 100, 1, 3).withColumn("text", F.lit("a")), "row")
    found = {r["id"]: r["row"] for r in rows.collect()}
    assert len(found) == len(set(found.values())) == 100 and found == {r["id"]: r["row"] for r in rows.collect()}
