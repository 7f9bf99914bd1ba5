import random

from tests.llm.test_neardup import brute as groups_of
from tests.llm.test_suffix import brute as removals_of


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline
    from lodestar.llm import secrets

    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "the", "or", "is", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [some(rng.randint(30, 120)) for _ in range(120)]
    passage = some(40)
    texts += [passage + " " + some(40), some(30) + " " + passage, texts[3], texts[4] + " more", "%%% $$$ ".join(some(1) for _ in range(60)), f"{some(90)} password=b7db7aa4a5fcc78305 {some(90)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "best-fit packing":
            assert now.dtypes == docs.dtypes
        steps.append({r["doc_id"]: r for r in now.collect()})
    kept, single, cut, clean, packed = steps
    assert 124 not in kept and len(kept) >= 123
    groups = groups_of([(i, r["text"]) for i, r in kept.items()], 5, 80)
    assert set(single) == {i for i, _, c in groups if i == c} and 122 not in single
    want = removals_of([(i, r["text"]) for i, r in single.items()], 50)
    assert all(len(r["text"].encode()) == want[i][0] - want[i][1] and r["n_chars"] == len(r["text"]) for i, r in cut.items())
    assert "b7db7aa4a5fcc78305" not in clean[125]["text"] and secrets.REPLACEMENT in clean[125]["text"]
    assert all(r["text"] == cut[i]["text"] for i, r in clean.items() if i != 125)
    assert set(packed) == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(packed)


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, clashing column names, and empty tables."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ("r_id", "r_hash", "row_hash", "g", "_g", "_row", "_key", "_tokens", "_gone_id", "_gone_hash", "component_id", "label")
    odd = odd.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    wide = odd.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    wide = wide.unionAll(wide.where("doc_id = 7"))  # a repeated row
    rows = sorted(map(str, wide.collect()))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (wide, wide.limit(0)):
            got = stage(spark, docs, str(tmp_path))
            if name == "best-fit packing":
                assert got.count() >= docs.count()
                continue
            assert got.dtypes == docs.dtypes
            found = got.collect()
            if docs is not wide:
                assert not found
            elif name == "MinHash near-dedup":  # 10 repeats 7, in two rows
                assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted([*range(10), 11, 3, 7])
                assert sum(r["doc_id"] is None for r in found) == 2
            elif name == "suffix-array dedup":
                assert sorted(str(r) for r in found if r["doc_id"] != 10) == sorted(x for x in rows if "doc_id=10," not in x)
            else:
                assert sorted(map(str, found)) == rows


def test_near_dedup_keeps_the_other_text_of_a_repeated_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    a, b = (" ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(40)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (3, a), (3, b), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.neardup_stage(spark, docs, str(tmp_path)).collect())) == [(1, a), (3, b)]
