from pyspark.sql import functions as F

from cardsight.llm import labelled, quality, toxicity

from .frames import edge_documents

MID = "/root/testdata/sf0.1"


def ranks_well(scored, labels, label, held):
    rows = scored.withColumn("held_out", held).join(labels, "doc_id").where("held_out").select("score", label).collect()
    pos, neg = [r.score for r in rows if r[label]], [r.score for r in rows if not r[label]]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg)), pos, neg


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    model = toxicity.fit(docs, labels, ~labelled.held_out(4, 2))
    area, pos, neg = ranks_well(toxicity.score(docs, model), labels, "toxic", labelled.held_out(4, 2))
    assert area > 0.95 and sum(x >= 0.3 for x in neg) <= 0.01 * len(neg) and sum(x >= 0.3 for x in pos) > 0.7 * len(pos)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    model = quality.fit(docs, labels, ~labelled.held_out(5, 0))
    area, pos, neg = ranks_well(quality.score(docs, model), labels, "quality", labelled.held_out(5, 0))
    assert area > 0.98 and sum(x < 0.3 for x in pos) <= 0.01 * len(pos) and sum(x < 0.3 for x in neg) > 0.9 * len(neg)


def test_interactions_beyond_additive_weights():
    """Neither word alone is label 1, the pair is: a machine with factors learns it."""
    import numpy as np
    r = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(sorted(({10} if a else set()) | ({20} if b else set()) | set(r.integers(100, 140, 4).tolist())))
        y.append(float(a == b))
    data = {"y": np.array(y, np.float32), "weight": np.ones(len(y), np.float32),
            "bounds": np.concatenate(([0], np.cumsum([len(x) for x in rows]))), "slot": np.concatenate(rows).astype(np.int32)}
    hit = lambda m: ((toxicity.sigmoid(m.logits(data["bounds"], data["slot"])) >= 0.5) == data["y"]).mean()
    assert hit(toxicity.fit_sparse(dict(data), bits=8, epochs=300, min_z=-1)) > 0.9


def test_pairs_of_words_as_common_in_both_labels(spark):
    """Insult and group mention are each as common in both labels, only together (or both missing) they are label 1;
    learnt with the defaults of the query's fit, judged on other documents."""
    import numpy as np
    r = np.random.default_rng(1)

    def rows(first, n):
        out = []
        for i in range(first, first + n):
            insult = bool(r.random() < 0.5)
            words = [f"w{x}" for x in r.integers(0, 300, 20)]
            words += [f"insult{x}" for x in r.integers(0, 60, 2)] if insult else []
            words += [f"group{x}" for x in r.integers(0, 10, 2)] if insult == bool(i % 2) else []
            out.append((i, " ".join(words), i % 2))
        return out

    learn, held = rows(0, 8000), rows(8000, 2000)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame(learn).drop("toxic"), frame(learn).drop("text"), F.lit(True))
    y = {d: t for d, _, t in held}
    scored = toxicity.score(frame(held).drop("toxic"), model).collect()
    assert sum((s.score >= 0.5) == bool(y[s.doc_id]) for s in scored) > 0.85 * len(held)


def test_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(0, 1, 1), (7, 0, 0), (8, None, 0), (None, 1, 1), (9, 1, None), (0, 1, 0), (11, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for fit, score, label in ((toxicity.fit, toxicity.score, "toxic"), (quality.fit, quality.score, "quality")):
        for given in (labels, labels.limit(0)):
            model = fit(docs, given, F.lit(True), label=label)
            got = score(docs, model).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
            assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
            assert score(docs.limit(0), model).count() == 0
    kept = toxicity.reject(docs, toxicity.fit(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns
