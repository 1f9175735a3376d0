import itertools
import random
import re

import pytest

from cardsight.llm.licenses import GAP, LONG, PHRASES, SHARE, TEMPLATES, build, op11_license_scan, scan, statistics, word_list

from .frames import edge_documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def base(text, phrases=PHRASES):
    """n_words, n_base, first, last, labels by looking at every place."""
    w = plain_words(text)
    hits = [(i, label) for label, p in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def pieces(w, t, long):
    """Every piece of the template ``t`` in ``w`` that cannot be extended: (word, place, size)."""
    out = set()
    for i, j in itertools.product(range(len(w)), range(len(t))):
        if w[i] == t[j]:
            n = 0
            while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                n += 1
            if n >= min(long, len(t)) and (i == 0 or j == 0 or w[i - 1] != t[j - 1]):
                out.add((i, j, n))
    return sorted(out)


def best_share(w, t, long=LONG, gap=GAP):
    """Largest covered share over all chains of all pieces, by looking at every chain."""
    found = pieces(w, t, long)

    def longest(last):
        best = 0
        for p in found:
            if last is None:
                best = max(best, p[2] + longest(p))
            elif p[0] > last[0] and p[1] > last[1]:
                over = max(last[0] + last[2] - p[0], last[1] + last[2] - p[1], 0)
                between = (p[0] - last[0] - last[2]) - (p[1] - last[1] - last[2])
                if over < p[2] and between <= gap:
                    best = max(best, p[2] - over + longest(p))
        return best
    return longest(None) / len(t)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def notices(spark):
    r = random.Random(5)
    texts = []
    for n, (_, t) in enumerate(TEMPLATES):
        w = t.split()
        texts += [prose(n, 30) + "\n" + t + "\n" + prose(n + 50, 30), t.upper().replace(" ", "\n * "),
                  " ".join(x for x in w if r.random() > 0.12), " ".join(w[:len(w) // 2]),
                  " ".join(w[:len(w) // 3] + ["another", "word"] + w[len(w) // 3:])]
    texts += ["MIT License, mit-license; the MIT\tlicense", "the Apache Licenses", "licence mit license", "mit license" * 3,
              "general public license general public license", "All rights reserved. " * 40, "", None, "MİT LICENSE", "ümit license"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_equals_a_search_of_every_place_and_chain(spark):
    texts, docs = notices(spark)
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, w = got[i], plain_words(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        shares = [(label, best_share(w, plain_words(t))) for label, t in TEMPLATES if len(w) < 400 and "reserved. All" not in (text or "")]
        if not shares:
            continue
        labels = {x for x in r.base_labels.split(",") if x} | {label for label, s in shares if s >= SHARE}
        assert r.labels == ",".join(sorted(labels)), text
        assert r.score == pytest.approx(max([1.0 if r.n_base else 0.0, *[s for _, s in shares]])), text
        for s in r.spans:
            assert 0 <= s.first_word <= s.last_word < r.n_words and 0 < s.share <= 1


def test_whole_notices_are_found_where_they_stand(spark):
    docs = spark.createDataFrame([(1, "All rights reserved. " * 40), (2, prose(1, 50) + " " + TEMPLATES[1][1] + " " + prose(2, 20))],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert [(s.first_word, s.share) for s in got[1].spans] == [(3 * i, 1.0) for i in range(40)]
    assert [(s.label, s.first_word, s.covered) for s in got[2].spans if s.share == 1] == [("mit", 50, len(word_list(TEMPLATES[1][1])))]


def test_matching_statistics_of_the_automaton():
    a = build([("x", "a b c a b d"), ("y", "b c a a b c")], [("z", "c a")])
    texts = [t.split() for t in ("a b c a b d", "b c a a b c", "c a")]
    r = random.Random(3)
    for _ in range(200):
        w = [r.choice("abcde") for _ in range(12)]
        states, lengths = statistics(a, [a.vocabulary.get(x.encode(), -1) for x in w])
        for i in range(len(w)):
            for t, text in enumerate(texts):
                want = max(n for n in range(i + 2) if n == 0 or any(text[j:j + n] == w[i + 1 - n:i + 1] for j in range(len(text))))
                assert min(lengths[i], a.depth[states[i], t]) == want
            assert lengths[i] == max(min(lengths[i], x) for x in a.depth[states[i]])


def test_edges_and_empty_tables(spark):
    docs = edge_documents(spark)
    rows = docs.collect()
    want = sorted([(r.doc_id, *base(r.text)) for r in rows], key=str)
    got = rows_of(scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert got == want
    assert scan(docs.limit(0)).count() == 0
    assert scan(docs, templates=[], phrases=[]).filter("n_base > 0 or score > 0").count() == 0


def test_query_equals_the_base_rule_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op11_license_scan(spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert rows_of(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) \
        == sorted([(d.doc_id, *base(d.text)) for d in docs], key=str)
    lines = {"mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "reserved": "All rights reserved."}
    found = {r.doc_id: r.labels.split(",") for r in got.collect()}
    for label, line in lines.items():
        assert {d.doc_id for d in docs if line in (d.text or "")} <= {i for i, x in found.items() if label in x}
