import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orderloom.llm import alignment
from orderloom.llm.token_counts import byte_symbols

SCHEMA = "doc_id bigint, text string, key string, n_a int, copies int"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = {c: i for i, c in enumerate(byte_symbols())}


def whole_text(text):
    """(ids of A, ids of B, groups, links) of a text encoded whole, or None."""
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    bytes_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [B.id_to_piece(i)]]
    if not (b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode()):
        return None
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 400 else _ends(parts)
    at_a, at_b = ends(bytes_a), ends(bytes_b)
    common = sorted(set(at_a) & set(at_b))
    groups, links, low = [], [], 0
    for c in common:
        groups.append(",".join(str(i) for i, e in zip(a, at_a, strict=True) if low < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, at_b, strict=True) if low < e <= c))
        low = c
    owner_b = {}
    for i, e in zip(b, at_b, strict=True):
        owner_b.setdefault(e, []).append(i)
    links = [(i, j) for i, e in zip(a, at_a, strict=True) for j in owner_b.get(e, [])]
    return a, b, groups, links


def _ends(parts):
    out, n = [], 0
    for p in parts:
        n += len(p)
        out.append(n)
    return out


def brute(rows):
    done = [(r[0], whole_text(r[1]) if r[1] else None) for r in rows]
    count = Counter(x for _, d in done if d for x in d[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc, d in done:
        if d is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), sha))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(6)
    words = ["the", "The", "naïve", "été,", "  ", "\n\n", "\t", "a b", "日本語", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "it's", "'s", "123456", "x　y", "😀", "é", "***", "\u0085", "Ünïcode", "don't", "ﬁ", "|", "\x00", "\x1f", " ", "-", "ß"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 25))) for _ in range(500)]
    pool = [chr(c) for c in range(1, 0x3100)] + list("aaaa bb  \n\t<'s'll") * 400
    texts += ["".join(rnd.choices(pool, k=rnd.randint(1, 50))) for _ in range(500)]
    texts += ["a▁b", "plain words", "▁", "", None, " ", "  lead", "trail  ", " é", "é ", "à b", "x" * 3000, "word " * 3000, "  a", "a  b"]
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)]
    return rows + [(9000 + i, "plain words", "clash", 1, 2) for i in range(50)] + [rows[0], rows[0], (None, "the the", "", 0, 0), (None, None, "", 0, 0)]


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 0])
def test_against_whole_texts(spark, broadcast):
    rows = corpus()
    got = alignment.alignment(spark.createDataFrame(rows, SCHEMA).repartition(4), broadcast_pairs=broadcast)
    assert got.columns == list(NAMES)
    got, want = sorted((tuple(r) for r in got.collect()), key=str), brute(rows)
    assert [r for r in got if r not in set(want)] == [] and got == want
    assert sum(r[1] == 0 for r in want) > 5  # some texts aren't given back


def test_empty_table(spark):
    assert alignment.op12_alignment(spark.createDataFrame([], SCHEMA)).collect() == []
    got = alignment.op12_alignment(spark.createDataFrame([(1, None, "", 0, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_words_join_to_their_text():
    rows = [r[1] for r in corpus()]
    offsets, flat = alignment.words_between_single_spaces(pa.array(rows, pa.large_string()))
    words = flat.to_pylist()
    for t, s, e in zip(rows, offsets[:-1], offsets[1:], strict=True):
        assert " ".join(words[s:e]) == (t or "")
