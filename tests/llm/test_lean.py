import pyarrow as pa

from girthline.llm import bpe, jaccard, langid, lean, tokens


def test_a_task_leaves_nothing_remembered():
    """A worker that has encoded texts keeps no encoder, and no words, when it goes on with another operator's tasks."""
    bpe._loaded["a key"], tokens._hashes[b"word"] = "an encoder", 1
    seen = []

    def run(batches):
        seen.append((dict(bpe._loaded), dict(tokens._hashes)))
        for b in batches:
            tokens._hashes[b"word"] = 1
            yield b

    batch = pa.RecordBatch.from_pydict({"n": [1]})
    assert list(lean.task(run)(iter([batch, batch]))) == [batch, batch]
    assert seen == [({}, {})] and not tokens._hashes


def test_memory_goes_back_after_large_groups_only():
    tokens._hashes[b"word"], bpe._loaded["a key"] = 1, "an encoder"
    small, large = pa.table({"n": [1]}), pa.table({"n": range(200_000)})
    assert lean.group(lambda t: t, small) is small and bpe._loaded
    assert lean.group(lambda t, a: a, large, small) is small and not bpe._loaded and tokens._hashes
    tokens._hashes.clear()


def test_near_duplicates_send_workers_small_batches(spark, monkeypatch):
    before, seen = spark.conf.get(lean.SETTING), []
    monkeypatch.setattr(jaccard, "classified", lambda docs, *_: seen.append(spark.conf.get(lean.SETTING)) or docs)
    jaccard.classes(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert seen == [str(lean.BATCH)] and spark.conf.get(lean.SETTING) == before


def test_language_sends_a_text_once(spark):
    """The text is found among the other columns, in any case of its name, and not sent to workers a second time."""
    docs = spark.createDataFrame([("x", "ein Wort", 1), ("y", None, 2)], "a string, Text string, b int")
    got = langid.predict(docs, [("de", 101, 0)])
    assert got.columns == ["a", "Text", "b", "lang_pred", "score"]
    assert [tuple(r)[:4] for r in got.collect()] == [("x", "ein Wort", 1, "de"), ("y", None, 2, "und")]
    assert "text" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Text", "")
