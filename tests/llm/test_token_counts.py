import random

import public_tokenizers
from tokenizers import Tokenizer

from orderloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_against_the_library(spark):
    rnd = random.Random(1)
    pool = [chr(c) for c in range(1, 0x3100)] + list("aaaa bb  \n\t<'s'll") * 200 + ["<|endoftext|>"] * 100
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 30000, " " * 300 + "x", "<|endoftext|> a<|endoftext|>", "", None, "😀" * 50, "the the the\n\n the"]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    library = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows}
    for r in token_counts.op9_token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")).collect():
        assert (r.n_bytes, r.n_tokens) == want[r.doc_id] and r.over_limit == (r.n_tokens > 512)


def test_empty_table(spark):
    assert token_counts.op9_token_counts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_long_pre_tokens_against_the_library():
    import time

    rnd = random.Random(2)
    library, mine = Tokenizer.from_file(PATH), token_counts.RankMerger(PATH)
    texts = ["a" * 5001, "".join(rnd.choices("abcde", k=3000)), "ab" * 2000 + "a", "".join(rnd.choices("etaoinshrdlu", k=20000)), "é" * 700, "=-" * 900]
    for t in texts:
        assert mine.count_long(t) == len(library.encode(t, add_special_tokens=False).ids)
    began = time.process_time()
    mine.count_long("".join(rnd.choices("etaoinshrdluabcdefgh", k=200_000)))
    assert time.process_time() - began < 20


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.op9_token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [("1", 2), ("1", 2), ("None", 0), ("None", 1)]
