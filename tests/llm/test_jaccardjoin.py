import re

from cardsight.llm.components import components
from cardsight.llm.jaccardjoin import join

from .frames import changed, edge_documents, prose


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    """rows [(id, text)] -> sorted (id, size, smallest id of the component)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = got(join(docs))
    assert out == brute(rows)
    assert any(d != c for d, _, c in out)


def test_edges(spark):
    docs = edge_documents(spark)
    assert got(join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_group_of_near_copies_and_chains(spark):
    base = prose(50, 200)
    texts = [changed(base, 150 + i, f"q{i}") for i in range(40)]
    chain = [prose(51, 100)]
    for i in range(6):
        w = chain[-1].split(" ")
        chain.append(" ".join(w[3:] + [f"c{i}a", f"c{i}b", f"c{i}c"]))
    texts += chain + [base + " " + prose(52, 400), "a b c d e", "a b c d", "a b c d e f"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    assert got(join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty(spark):
    assert join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    assert sorted((r.node, r.root) for r in components(path).collect()) == \
        [(i, 0) for i in range(61)] + [(100, 100), (200, 100)]


def test_pairs_whose_common_columns_are_late_in_the_prefix(spark):
    """Two revisions share 90 of 100 shingles each; the other 10 are rarest (one short text more has them), and other
    texts, not linked to them, are the star centres of the common ones."""
    texts = []
    for g in range(6):
        common, longer = prose(600 + 10 * g, 94), prose(601 + 10 * g, 200)
        for side in (602, 603):
            tail = prose(side + 10 * g, 10)
            texts += [f"{common} {tail}", " ".join(f"{common} {tail}".split(" ")[-14:])]
        for j in range(4):
            texts += [f"{common} {longer} d{g}x{j}", f"{longer} e{g}x{j}"]
    rows = list(enumerate(texts))
    out = brute(rows)
    first = {d: c for d, _, c in out}
    assert all(first[12 * g + 2] == first[12 * g] for g in range(6))
    assert got(join(spark.createDataFrame(rows, "doc_id long, text string"))) == out
