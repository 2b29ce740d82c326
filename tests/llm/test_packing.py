import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from orderloom.llm import packing

SCHEMA = "doc_id bigint, text string, length string, sequence_id int"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(5)
    words = ["the", "Idiot", "naïve,", "ÀB", "à", "Åà\u00a0x", "it's", "x1y2", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "\n", "\t"]
    some = [" ".join(rnd.choices(words, k=rnd.randint(0, 900))) for _ in range(60)]
    return [*some, *some[:20], "", None, "   ", " ".join(["w"] * 5000), "a" * 20000, "\x0b\x0c"]


def check(rows, capacity, ids):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert set(by_doc) == set(ids)
    for i, want in ids.items():
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            part = np.array(want[at : at + capacity], "<u4")
            assert (r.piece, r.start, r.length, r.ids_crc32) == (n, at, len(part), zlib.crc32(part.tobytes()))
            at += capacity
        assert at >= len(want)


def test_pieces_and_places(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    t = Tokenizer.from_file(PATH)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in rows}
    got = packing.op1_packing(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got, 2048, ids)
    free = []  # first fit, longest first, with all bins open
    for n in sorted((r.length for r in got), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        free[at : at + 1] = [(free[at] if at < len(free) else 2048) - n]
    assert len({r.sequence_id for r in got}) <= len(free)


def test_sequences_hold_the_ids(spark):
    rows = [(i, t, "", 1) for i, t in enumerate(texts()[:30])]
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), capacity=64, with_ids=True)
    made = {r.sequence_id: r.tokens for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_empty_repeated_and_null_rows(spark):
    assert packing.op1_packing(spark.createDataFrame([], SCHEMA)).collect() == []
    got = packing.op1_packing(spark.createDataFrame([(1, "a b", "", 1), (1, "a b", "", 1), (None, None, "", 1)], SCHEMA)).collect()
    assert len(got) == 3 and sorted(r.offset for r in got)[0] == 0


def test_bounded_space_and_bitset():
    rnd = random.Random(2)
    bins, used = packing.OpenBins(100, 5), {}
    for _ in range(3000):
        n = rnd.randint(1, 100)
        at, offset = bins.place(n)
        assert used.get(at, 0) == offset and offset + n <= 100
        used[at] = offset + n
        assert bins.open <= 5 and bins.bits == sum(1 << f for f in range(101) if bins.free[f])
    assert len(used) <= 1.12 * sum(used.values()) / 100


def test_ids_of_odd_letters_against_the_library():
    rnd = random.Random(9)
    library = Tokenizer.from_file(PATH)
    low, high = [chr(c) for c in range(1, 0x250)], [chr(c) for c in range(0x250, 0x3000, 7)]
    some = ["EKONOM\u0130.", "GELD\u0130!", "\u0130", "i\u0307.", "\u0130stanbul,", *(c + m for c in low for m in (".", "a.", "!?"))]
    some += ["".join(rnd.choices(low, k=rnd.randint(1, 9))) + rnd.choice([".", "!", "", " "]) + "".join(rnd.choices(low + high, k=5)) for _ in range(8000)]
    parts = packing.PartIds(PATH)
    for i in range(0, len(some), 500):
        block = some[i : i + 500]
        coded = packing.words_of(pa.array(block, pa.large_string()), lower=False)
        ids = parts.words(coded[1]).to_pylist()
        for n, text in enumerate(block):
            got = [x for own in ids[coded[0][n] : coded[0][n + 1]] for x in own]
            assert got == library.encode(text, add_special_tokens=False).ids, text
