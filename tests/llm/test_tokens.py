import itertools
import random

import numpy as np

from weftline.llm import tokens

RANKS = open(tokens.VOCAB, "rb").read()


def test_counts_equal_the_tokenizer():
    r = random.Random(5)
    enc = tokens.encoder(RANKS)
    letters = ["a", "b", "é", " ", "  ", "\n", "\t", "1", "23", "(", ").", "'s", "’", " ", " ", "漢", "😀", "x" * 70, "\x1c", "À", "×", "Ā ", " é", "é é"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 120))) for _ in range(1500)]
    texts += ["a", " ", " a", "a ", "  a", "word " * 5000, "é" * 300]
    c = tokens.Counter(RANKS)
    for _ in range(2):  # the second time from the table
        got, _, _ = c.measure([t.encode() for t in texts])
        assert got.tolist() == [len(enc.encode_ordinary(t)) for t in texts]


def test_hilbert_visits_neighbours():
    pts = np.array(list(itertools.product(range(8), repeat=3)))
    order = tokens.hilbert(pts, 3)
    assert sorted(order.tolist()) == list(range(512))
    walk = pts[np.argsort(order)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_measured(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "one two", "y"), (3, "one two", "y")], "doc_id long, text string, source string")
    rows = sorted(tokens.measured(df, "doc_id", "text", ("source",)).collect())
    assert [(r.doc_id, r.source, r.n_tokens) for r in rows] == [(1, "x", None), (2, None, 0), (3, "y", 2), (3, "y", 2)]
    assert tokens.measured(df.limit(0), "doc_id", "text").count() == 0
