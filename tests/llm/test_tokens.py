import os

import pytest

from cladeflow.llm import tokens

PATH = os.path.join(tokens.TOKENIZERS, tokens.RANKS)


@pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")
def test_counts(spark):
    texts = [None, "", "a", "hello  world\n", "naïve 文字 <|endoftext|>", "x" * 20_000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    e = tokens.encoding(PATH)
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary(texts[4])) == texts[4]
    assert tokens.count_tokens(df.limit(0)).count() == 0
