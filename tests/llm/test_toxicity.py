import random
import zlib

import numpy as np

from orderloom.llm import toxicity

DOCS, LABELS = "doc_id bigint, text string, lang string, score double", "doc_id bigint, quality int, toxic int"


def corpus(n=900):
    rnd = random.Random(4)
    plain = {"en": "the of and to river stone house walk green light".split(), "de": "der die und das haus wald grün licht stein gehen".split()}
    bad = {"en": ["scumbag", "idiotic", "idiot"], "de": ["dummkopf", "dummkerl"]}
    docs, labels = [], []
    for i in range(n):
        lang = rnd.choice(["en", "de"])
        words = rnd.choices(plain[lang], k=rnd.randint(5, 60))
        y = int(rnd.random() < 0.3)
        if y:
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad[lang]))
        docs.append((i, " ".join(words), lang, 0.0))
        labels.append((i, 0, y))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus()
    extra = [(2000, "", "en", 0.0), (2001, None, None, 0.0), (2002, "x" * 50000, "en", 0.0), (None, "the idiot", "en", 0.0)]
    d = spark.createDataFrame(docs + extra, DOCS)
    out = toxicity.op10_toxicity(d, spark.createDataFrame(labels + [(5, None, None), (None, 0, 1)], LABELS)).collect()
    assert len(out) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    again = toxicity.op10_toxicity(d.drop("lang", "score"), spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in out)


def test_empty_tables_and_one_label(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.op10_toxicity(spark.createDataFrame([], DOCS), none).collect() == []
    out = toxicity.op10_toxicity(spark.createDataFrame([(0, "a", "en", 0.0)], DOCS), none).collect()
    assert out[0].predicted == 0


def test_pooled_maxima_equal_a_plain_loop():
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    m = toxicity.Model(rnd.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rnd.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], rnd.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.1)
    texts = ["one two three four five", "", "a", None, "Wort wort WORT x", "to be or not to be"]
    t = toxicity.Texts.of(pa.array(texts, pa.large_string()))
    got = m.pooled(t)[0]
    for i, text in enumerate(texts):
        rows = []
        for word in (text or "").lower().split():
            _, buckets = toxicity.word_buckets(pa.array([word], pa.large_string()))
            rows.append(m.table[buckets].sum(0) * toxicity.spread(np.array([len(buckets)]))[0])
        x = np.array(rows + [np.zeros(toxicity.DIM)] * 2)
        want = []
        for f in m.filters:
            padded = np.concatenate([x, np.zeros((f.shape[0], toxicity.DIM))])
            outs = [sum(padded[p + k] @ f[k] for k in range(f.shape[0])) for p in range(len(x))]
            want.append(np.maximum(np.max(outs, axis=0), 0))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-4), text
    assert np.allclose(m.margin(t), got @ m.weights + 0.1, atol=1e-5)


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Words that only rows in other shards, or in long texts, hold are learned; the deal of rows to partitions does not show."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 300)
    docs, labels = corpus(1200)
    y = dict((i, t) for i, _, t in labels)
    docs = [(i, "the river house zorblax green light" if y[i] and i % 4 == 0 else x, g, s) for i, x, g, s in docs]
    long = [(5000 + i, "river stone " * 3000 + ("quuxify" if i % 2 else "walk"), "en", 0.0) for i in range(60)]
    labels += [(5000 + i, 0, i % 2) for i in range(60)]
    d = spark.createDataFrame(docs + long, DOCS)
    rows = toxicity.labelled(d, spark.createDataFrame(labels, LABELS))
    assert rows.count() == len(labels)
    m = toxicity.train(rows)
    probe = spark.createDataFrame([(1, "the river zorblax house", "en", 0.0), (2, "the river quuxify house", "en", 0.0), (3, "the river stone house", "en", 0.0)], DOCS)
    found = {r.doc_id: r.score for r in toxicity.scores(probe, m).collect()}
    assert found[1] >= 0.7 > found[3] and found[2] >= 0.7
    again = toxicity.train(rows.repartition(7))
    assert {r.doc_id: r.score for r in toxicity.scores(probe, again).collect()} == found


def test_texts_and_labels_meet_by_a_shuffle_at_any_size(spark, monkeypatch):
    seen, real = [], toxicity.staged
    monkeypatch.setattr(toxicity, "staged", lambda df, name: seen.append(df) or real(df, name))
    docs = spark.createDataFrame([(i, f"text {i}", "en", 0.0) for i in range(6)] + [(None, "none", "en", 0.0)], DOCS)
    marks = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, 1), (9, 0, 1), (None, 0, 1)], LABELS)
    found = toxicity.labelled(docs, marks)
    assert sorted(map(tuple, found.collect())) == [(1, "text 1", 1), (2, "text 2", 1)]
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
