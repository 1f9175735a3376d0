import hashlib
import re

import pytest

from cardsight.llm.linededup import dedup

from .frames import changed, edge_documents, prose


def word_set(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(rows, percent=80):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] is not None, r[1] or "")))
    seen, by_word, out = [], {}, []
    for i, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            s = word_set(line)
            near = {k for w in s for k in by_word.get(w, ())}
            if not any(100 * len(s & seen[k]) >= percent * len(s | seen[k]) for k in near):
                kept.append(line)
            if s and s not in by_word.get(next(iter(s)), {}):
                for w in s:
                    by_word.setdefault(w, set()).add(len(seen))
                seen.append(s)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()), key=str)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = got(dedup(docs))
    assert out == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges_and_kept_columns(spark):
    docs = edge_documents(spark)
    out = dedup(docs, keep=("lang", "source", "n_chars", "block"))
    assert got(out) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id, r.n_chars, r.source) for r in out.collect()} == {(r.doc_id, r.n_chars, r.source) for r in docs.collect()}


@pytest.mark.parametrize("percent", [60, 80])
def test_group_of_near_copies(spark, percent):
    base = [prose(70 + i, 20 + 3 * i) for i in range(4)]
    rows = [(i, "\n".join(changed(x, 12 + i % 7 + j, f"v{i}") for j, x in enumerate(base))) for i in range(80)]
    assert got(dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent)) == brute(rows, percent)


def test_empty(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_small_group_limits_give_the_same(spark, monkeypatch):
    from cardsight.llm import linededup
    base = [prose(170 + i, 25) for i in range(3)]
    rows = [(i, "\n".join(changed(x, 9 + (i * 7 + j) % 11, f"v{i % 9}") for j, x in enumerate(base))) for i in range(60)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup(df)) == want
    monkeypatch.setattr(linededup, "FULL", 3)
    monkeypatch.setattr(linededup, "FIRST", 1)
    monkeypatch.setattr(linededup, "GROW", 2)
    assert got(dedup(df)) == want
    monkeypatch.setattr(linededup, "TRIED", 5)
    assert got(dedup(df)) == want


def counted_passes(monkeypatch):
    """The passes over all blocks, as they are planned."""
    from cardsight.llm import linededup
    real, passes = linededup.with_notes, []
    monkeypatch.setattr(linededup, "with_notes", lambda blocks, notes, fn, *a, **b: passes.append(fn.__name__) or real(blocks, notes, fn, *a, **b))
    monkeypatch.setattr(linededup, "FULL", 3)
    monkeypatch.setattr(linededup, "FIRST", 1)
    monkeypatch.setattr(linededup, "GROW", 2)
    return passes


@pytest.mark.parametrize("couples, fetches", [(0, 2), (20, 1)])
def test_sets_are_fetched_once_unless_later_rounds_need_more_lines(spark, monkeypatch, couples, fetches):
    # the first line of the large groups is too long for the others, which meet in a later round only
    shared = " ".join(f"c{k}" for k in range(9))
    texts = [f"{shared} e0 e1 e2 e3"] + [f"u{i} {shared}" for i in range(11)]
    texts += [" ".join(["e0 e1 e2 e3"] + [f"f{i}x{k}" for k in range(16)]) for i in range(20)]
    texts += [" ".join([f"p{i}x{k}" for k in range(14)] + [f"q{i}x{j}"]) for i in range(couples) for j in range(2)]
    rows = list(enumerate(texts))
    passes = counted_passes(monkeypatch)
    out = got(dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == brute(rows) and sum(r[2] for r in out) == 10 + couples
    assert passes == ["prefixes"] + fetches * ["fetch"] + ["cut"]


def test_words_that_share_a_hint(spark, monkeypatch):
    from cardsight.llm import linededup
    rows = [(i, changed(prose(300 + i % 7, 20), 8 + i % 5, f"v{i % 4}") + "\n" + prose(400 + i, 15)) for i in range(30)]
    monkeypatch.setattr(linededup, "HINT_BYTES", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup(df)) == brute(rows)
    monkeypatch.setattr(linededup, "FULL", 3)
    monkeypatch.setattr(linededup, "FIRST", 1)
    assert got(dedup(df)) == brute(rows)


def test_stable_order():
    import numpy as np
    from cardsight.llm.linededup import stable_order
    keys = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64)
    for free in (4, 12, 56):        # places that do not fit, just fit, fit
        assert (stable_order(keys << np.uint64(free), free) == np.argsort(keys, kind="stable")).all()
