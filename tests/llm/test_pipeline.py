import random

import pytest

from .test_text_operators import labelled, prose

tokenizers = pytest.importorskip("public_tokenizers")


def test_pipeline_against_what_was_planted(spark, tmp_path):
    """Each stage drops, changes or packs just the documents made for it."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    rows, labels = labelled(rnd)
    junk = {i for i, q, _ in labels if not q}
    toxic = {i for i, _, t in labels if t}
    copied = prose(rnd, 300)
    for k in range(20):  # copies of one text, some with other spaces and capitals
        rows.append((1000 + k, copied if k % 3 else copied.replace(". ", ".\n").replace("ri", "Ri", k)))
    clean = prose(rnd, 80)
    rows.append((2000, f"{clean} write to me@mail.example.com or +1 (269) 555-3296 today"))
    full = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        assert name == "packing" or docs.columns == columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    every = {i for i, _ in rows}
    assert ids[0] == every - junk
    assert ids[1] == ids[0] - toxic
    assert ids[1] - ids[2] == set(range(1001, 1020)) and seen[2].count() == len(ids[2])
    texts = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert texts[2000] == f"{clean} write to [EMAIL] or [PHONE] today" and ids[3] == ids[2]
    library = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    pieces = sorted((r["doc_id"], r["start"], r["ids"]) for r in seen[4].collect())
    got = {i: [x for j, _, part in pieces if j == i for x in part] for i in ids[3]}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in seen[4].collect())


def test_stages_send_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """Whole texts of 10,000 rows at once, and as many again on their way back, outlast the stage in the workers' memory."""
    import corpus_pipeline
    import pyarrow as pa

    def sizes(docs, *_):
        def each(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        return docs.mapInArrow(each, "n long")

    for module, name in ((corpus_pipeline.quality_crf, "keep_good"), (corpus_pipeline.toxicity, "keep_clean"), (corpus_pipeline.simhash_dedup, "keep_one"), (corpus_pipeline.pii, "redact"), (corpus_pipeline.packing, "pack")):
        monkeypatch.setattr(module, name, sizes)
    for module in (corpus_pipeline.quality_crf, corpus_pipeline.toxicity):
        monkeypatch.setattr(module, "fit", lambda *_: None)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, setting = spark.range(700).selectExpr("id AS doc_id", "'x' AS text").coalesce(1), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for own, most in ((before, 256), ("0", 256), ("100", 100)):
            for name, stage in corpus_pipeline.STAGES:
                spark.conf.set(setting, own)
                got = [r["n"] for r in stage(spark, docs, str(tmp_path)).collect()]
                assert sum(got) == 700 and max(got) <= most, (own, name)
    finally:
        spark.conf.set(setting, before)


def test_words_are_cached_up_to_so_many_bytes():
    """Few but long words count as much as many short ones; what is forgotten is encoded again alike."""
    from tokenizers import Tokenizer

    from factmill.llm.packing import CACHE_BYTES, Tokens

    rnd, path = random.Random(5), tokenizers.path("word_bpe_49k.json")
    assert CACHE_BYTES <= 64 << 20
    own, library = Tokens(path, cache_bytes=200_000), Tokenizer.from_file(path)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=rnd.choice([3, 5, 400]))) for _ in range(100)) for _ in range(60)]
    for at in range(0, 60, 5):
        part = texts[at : at + 5]
        assert own.encode_all(part) == [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in part]
        assert sum(len(w) + len(ids) for w, ids in own.cache.items()) < 200_000 + sum(5 * len(t) for t in part)
