import random
import zlib

import numpy as np
import pyarrow as pa

from orderloom.llm import quality

DOCS, LABELS = "doc_id bigint, text string, lang string, score double", "doc_id bigint, quality int, toxic int"


def corpus(n=900):
    rnd = random.Random(4)
    plain = "the of and to river stone house walk green light der die und das wald grün gehen".split()
    docs, labels = [], []
    for i in range(n):
        words, y = rnd.choices(plain, k=rnd.randint(8, 60)), 1
        if rnd.random() < 0.35:
            y = 0
            kind = rnd.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [x for w in words for x in (w, "|")] if kind == 1 else [x for w in words for x in [w] * 5]
        docs.append((i, " ".join(words), "xx", 0.0))
        labels.append((i, y, 0))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus()
    extra = [(2000, "", "en", 0.0), (2001, None, None, 0.0), (2002, "x" * 50000, "en", 0.0), (None, "the river", "en", 0.0)]
    d = spark.createDataFrame(docs + extra, DOCS)
    out = quality.op13_quality(d, spark.createDataFrame(labels + [(5, None, None), (None, 0, 1), (6, 7, 0)], LABELS)).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {i: y for i, y, _ in labels}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, y) for i, q, y in labels]
    again = quality.op13_quality(d.drop("lang", "score").repartition(3), spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in out)


def test_empty_tables_and_one_label(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.op13_quality(spark.createDataFrame([], DOCS), none).collect() == []
    out = quality.op13_quality(spark.createDataFrame([(0, "a", "en", 0.0)], DOCS), none).collect()
    assert out[0].predicted == 0


def test_features_against_a_plain_loop():
    words = ["a", "the", "été", "日本", "x" * 40, "the"]
    starts, buckets = quality.word_features(pa.array(words, pa.large_string()))
    own = [sorted(buckets[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    for w, got in zip(words, own, strict=True):
        n = len(w.encode()) + 2
        assert len(got) == 1 + sum(max(0, n - g + 1) for g in quality.GRAMS) and min(got) > quality.REPEAT
        alone = quality.word_features(pa.array([w], pa.large_string()))[1]
        assert sorted(alone.tolist()) == got
    assert own[1] == own[5] and own[0] != own[1]


def test_margins_are_the_outputs_of_averaged_vectors():
    rnd = np.random.default_rng(1)
    table, out = rnd.normal(size=(quality.BUCKETS, 3)), rnd.normal(size=(2, 3))
    model = quality.Model(table @ (out[1] - out[0]), 0.25)
    texts = ["the the house", "", "Haus haus", None, "a", "x x x x"]
    t = quality.Texts.of(pa.array(texts, pa.large_string()))
    for i, margin in enumerate(model.margin(t)):
        bucket, share = t.features(i)
        z = out @ (share.astype(float) @ table[bucket])
        assert abs(margin - (z[1] - z[0] + 0.25)) < 1e-5
    assert t.repeats.tolist() == [1, 0, 0, 0, 0, 3]


def test_steps_follow_the_gradient():
    rnd = np.random.default_rng(2)
    table, out, bias = rnd.normal(size=(6, 3)), rnd.normal(size=(2, 3)), rnd.normal(size=2)
    bucket, share, y, e = np.array([1, 4]), np.array([0.25, 0.75]), 1, 1e-6
    loss = lambda t, o, b: -np.log(quality.softmax(o @ (share @ t[bucket]) + b)[y])
    for part in range(3):
        before = [table, out, bias]
        grad = np.zeros_like(before[part])
        for at in np.ndindex(grad.shape):
            up = [x.copy() for x in before]
            up[part][at] += e
            grad[at] = (loss(*up) - loss(*before)) / e
        after = [x.copy() for x in before]
        quality.descend(*after, bucket, share, y, 1.0)
        assert np.allclose(before[part] - after[part], grad, atol=1e-4)
