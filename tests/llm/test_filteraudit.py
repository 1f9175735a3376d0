import itertools
import re

from cardsight.llm.filteraudit import audit

from .frames import edge_documents, prose


def plain(docs, labels):
    """Every order applied one filter after the other to lists of rows."""
    good, toxic = {i for i, q, t in labels if i is not None and q == 1}, {i for i, q, t in labels if i is not None and t == 1}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", i, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                                     "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed_by, cells = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                out_now = [r for r in left if r[2][f]]
                removed_by[f] += len(out_now)
                redundant = sum(r[2][f] for r in gone)
                left, gone = [r for r in left if not r[2][f]], gone + out_now
                cells.append(("".join(order), step, len(left), len(out_now), redundant,
                              sum(r[2][f] and sum(r[2].values()) == 1 for r in mine),
                              sum(r[1] in good for r in out_now), sum(r[1] in toxic for r in out_now), f))
        out += [(part, *c[:-1], removed_by[c[-1]], c[-1]) for c in cells]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_every_order_applied_in_turn(spark):
    docs = edge_documents(spark)
    many = [(100 + i, "Some $ text " + prose(i % 3, 210, 60 if i % 2 else 4000), ["en", "de", None, ""][i % 4]) for i in range(40)]
    docs = docs.select("doc_id", "text", "lang", "n", "bucket", "size") \
        .unionByName(spark.createDataFrame(many, "doc_id long, text string, lang string").selectExpr(
            "*", "1 as n", "2 as bucket", "3 as size")).withColumnRenamed("bucket", "bits").withColumnRenamed("size", "part")
    labels = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, None), (None, 1, 1), (16, 1, 1), (3, None, 1), (100, 1, 0), (103, 0, 1), (900, 1, 1)]
    frame = spark.createDataFrame([(*x, "n", 1) for x in labels], "doc_id long, quality int, toxic int, part string, hash int")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = plain(rows, labels)
    assert got(audit(docs, frame)) == want and {r[0] for r in want} == {"", "en", "de"}


def test_large_groups_of_copies_and_rows_without_ids(spark):
    docs = [(i, "copy", "en") for i in range(400)] + [(None, "copy", "en")] * 300 + [(5, "copy", "fr")] + [(7, "other", "fr")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(0, 1, 1), (399, 1, 0)], "doc_id long, quality int, toxic int")
    assert got(audit(frame, labels)) == plain(docs, [(0, 1, 1), (399, 1, 0)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    assert audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).count() == 600
