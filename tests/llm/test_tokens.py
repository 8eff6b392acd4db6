"""One vocabulary used word by word and on whole texts in one process."""

from corpusforge.llm import tokens


def test_words_and_whole_texts_have_encoders_of_their_own():
    name, texts = "word_bpe_49k.json", [b"", b"one two  three", "déjà vu\n".encode()]
    by_word = tokens.encoder(name).counts(texts)
    assert tokens.whole_counts(name, texts) == list(by_word)
    tokens._encoders.clear()
    tokens._libraries.clear()
    whole = tokens.whole_counts(name, texts)
    assert list(tokens.encoder(name).counts(texts)) == whole
