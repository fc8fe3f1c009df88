from jobweave.llm.tokens import ByteTokenizer


def test_the_exact_tokenizer_is_loaded_only_when_a_text_needs_it():
    tokenizer = ByteTokenizer(ByteTokenizer.default_path())
    plain = tokenizer.encode("a plain text")
    assert "exact" not in vars(tokenizer)
    assert plain.tolist() == tokenizer.encode_exact("a plain text").tolist()
    assert "exact" in vars(tokenizer)
