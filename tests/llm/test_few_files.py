"""Files that Spark commits for token shards, and words encoded in several calls."""

from __future__ import annotations

from corpusforge.llm import tokenfiles, tokens

from .test_operators import frame


def test_the_manifest_is_one_file_for_any_number_of_shards(spark, tmp_path):
    docs = frame(spark, [(i, f"one two three {i} " * 50) for i in range(200)])
    found = tokenfiles.write_ids(docs, str(tmp_path), shard_bytes=10_000)
    assert found.count() > 5
    assert len(list((tmp_path / "manifest").glob("*.parquet"))) == 1
    assert tokenfiles.read_documents(spark, str(tmp_path)).count() == 200


def test_words_encoded_in_several_calls_have_the_same_ids(monkeypatch):
    texts = [" ".join(f"w{i}€x" if i % 50 == 0 else f"new{i}" for i in range(lo, lo + 400)).encode() for lo in range(0, 2000, 300)]
    want = tokens.WordEncoder("word_bpe_49k.json").ids(texts)
    monkeypatch.setattr(tokens, "ENCODE_WORDS", 7)
    assert tokens.WordEncoder("word_bpe_49k.json").ids(texts) == want
