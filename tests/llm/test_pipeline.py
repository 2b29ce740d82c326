import random

import corpus_pipeline as cp

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(folder, spark):
    rnd = random.Random(12)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(3000)]
    words = lambda n: " ".join(["the", "of", "and", *rnd.choices(vocab, k=n)])
    docs, toxic = [], set()
    for i in range(300):
        text = words(40) + "\n" + words(30)
        if i % 4 == 0:
            text = text.replace(" of ", " of scumbag ", 1)
            toxic.add(i)
        docs.append([i, text])
    exact = [[400 + i, docs[1][1]] for i in range(5)]
    base = words(300)
    near = []
    for i in range(6):
        w = base.split()
        w[20 * i + 7] = "changed"
        near.append([500 + i, " ".join(w)])
    line = words(25)
    lines = [[600 + i, words(40) + "\n" + line] for i in range(4)]
    items = [words(30) for _ in range(10)]
    leaks = [[700 + i, words(50) + " " + items[i] + " " + words(40)] for i in range(5)]
    rest = [[800, ""], [801, None], [802, words(3000)]]
    rows = [(i, t, "en", "clash", len(t or "")) for i, t in docs + exact + near + lines + leaks + rest]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, line


def test_stages_do_their_work(spark, tmp_path):
    rows, toxic, line = corpus(str(tmp_path), spark)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES[:-1]:
        docs = cp.staged(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    every = {r[0] for r in rows}
    tox, lines, near, clean = (kept[n] for n, _ in cp.STAGES[:-1])
    assert every - set(tox) <= toxic and len(toxic & set(tox)) <= 3
    assert set(lines) == set(tox) - {400, 401, 402, 403, 404} - ({501, 502, 503, 504, 505} - set(lines))
    assert sum(line in (t or "") for t in lines.values()) == 1 and line in lines[600]
    assert not {501, 502, 503, 504, 505} & set(near) and 500 in near
    assert set(near) - set(clean) == {700, 701, 702, 703, 704} & set(near)
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(clean)
    assert all(r.offset + r.length <= 2048 for r in out)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
