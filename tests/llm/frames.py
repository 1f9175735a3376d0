"""Hand-made documents with the awkward cases every operator has to stand."""

import random


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary):04d}" for _ in range(n))


def changed(text: str, every: int, mark: str = "zz") -> str:
    return " ".join(mark + str(i) if i % every == every // 2 else w for i, w in enumerate(text.split(" ")))


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    base, long_ = prose(1, 120), prose(2, 9000)
    lines = "\n".join(prose(10 + i, 12) for i in range(6))
    texts = [
        (0, base), (1, base), (2, changed(base, 40)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "One"),
        (8, "one two three"), (9, long_), (10, long_ + " tail"), (11, lines), (12, lines + "\nlast line of this text"),
        (13, changed(long_, 900)), (14, "é" * 60), (15, "é" * 60 + " ü"), (None, base), (None, prose(3, 50)),
        (16, prose(4, 60)), (16, prose(4, 60)), (17, "a a a a a a a a"), (18, "a a a a a a a a a"), (19, "x" * 5000),
        (20, prose(5, 30) + " " + base), (21, "tab\tseparated\x0bwords\x0chere\rand\nthere"), (22, base.upper()),
    ]
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", n, 1.5, "clash", 7, 8, 9, 3, "q", 2, 4)
            for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars int, score double, block string, size int, "
              "rank int, n int, bucket int, kind string, copies int, line int").repartition(3)
