"""The pipeline's stages on a small corpus of awkward rows, each against what it should keep."""

import random
import zlib

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, spans string, class_id long, key string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(30, 90)) for _ in range(300)]
    texts[5] += " password = hunter2hunter2 end."
    junk = {i for i in range(300) if i % 6 == 1}
    texts = [" ".join(w + "$$$" for w in t.split()) if i in junk else t for i, t in enumerate(texts)]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 11 == 0 else ("hot" if i % 3 else "cold")) for i, t in enumerate(texts)]
    rows += [(300 + i, texts[i], "en", "copy") for i in (2, 3, 4)] + [(400, " ".join([*texts[8].split()[:-1], "other."]), "en", "copy"), (500, None, None, None), (501, "", "en", "hot"), (None, prose(rng, 40), "en", "hot")]
    rows += [(600, prose(rng, 20_000), "en", "long"), rows[20]]
    docs = spark.createDataFrame([(i, t, la, s, len(t or ""), 1, 0.5, "x", 3, None) for i, t, la, s in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i not in junk), 0) for i in range(300)] + [(None, 1, 0), (9999, None, None)], "doc_id long, quality int, toxic int")
    path = str(tmp_path_factory.mktemp("corpus"))
    labels.write.parquet(f"{path}/labels.parquet")
    docs.write.parquet(f"{path}/documents.parquet")
    return path, texts, junk


def test_stages(spark, corpus):
    path, texts, junk = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    (_, quality), (_, near), (_, secrets), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = quality(spark, docs, path)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(held - junk - set(ids)) <= 0.1 * len(held - junk) and len(held & junk & set(ids)) <= 0.1 * len(held & junk)
    one = near(spark, docs, path)
    assert one.columns == docs.columns
    # texts 300 to 304 and 400 copy others, doc 20 comes twice, the null id stays
    left = [r.doc_id for r in one.select("doc_id").collect()]
    assert sorted(left, key=lambda x: (x is None, x)) == [*range(300), 500, 501, 600, None]
    clean = secrets(spark, docs, path)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.where("doc_id = 5").first()
    assert "hunter2" not in text.text and "[assign]" in text.text and text.n_chars == len(text.text)
    assert clean.where("doc_id = 600").first().text == docs.where("doc_id = 600").first().text
    mixed = mix(spark, docs, path)
    assert mixed.columns == docs.columns and mixed.count() > 0
    got = pack(spark, docs, path)
    counted = {r.doc_id for r in got.select("doc_id").collect()}
    assert counted == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, path).count() > 0


def test_stages_without_rows(spark, corpus):
    path = corpus[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_stages_of_null_rows(spark, corpus):
    path = corpus[0]
    docs = spark.createDataFrame([(None,) * 10] * 3 + [(1, *(None,) * 9)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).collect()
