import random
import re

import pyarrow as pa

from orderloom.llm.common import slices, words_of


def test_words_against_the_pattern():
    rnd = random.Random(3)
    pool = ["a", "B", "Z", "é", "à", "Å", " ", "\u0085", " ", " ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "日", "😀", "."]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(3000)] + ["", None, " ", "a", " a ", None]
    for part in (pa.array(texts), pa.array(texts, pa.large_string()).slice(7, 900), pa.array([], pa.string()), pa.array(["", None])):
        starts, flat = words_of(part)
        words = flat.to_pylist()
        want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in part.to_pylist()]
        assert [words[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)] == want
    assert words_of(pa.array(["Ab C"]), lower=False)[1].to_pylist() == ["Ab", "C"]


def test_slices_cover_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(slices(batch, "text", 20))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) == 3
