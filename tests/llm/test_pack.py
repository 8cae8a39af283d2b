import random
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import pack, tokens

DOCS = "doc_id long, text string, container int, n_tokens int"


def check(spark, data, caps, **kw):
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in data], DOCS).repartition(3)
    sizes = spark.createDataFrame(caps, "pack_id int, capacity_tokens long")
    rows = pack.pack(docs, sizes, **kw).collect()
    enc = tokens.encoder(open(tokens.VOCAB, "rb").read())
    want = {d: len(enc.encode_ordinary(t or "")) for d, t in data}
    for p, cap in caps:
        own = [r for r in rows if r.pack_id == p]
        fill, of = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r.container] += r.n_tokens
            of[r.doc_id].append(r)
        assert set(of) == set(want)
        assert max(fill.values(), default=0) <= cap
        for d, pieces in of.items():
            pieces.sort(key=lambda r: r.piece)
            at = 0
            for i, r in enumerate(pieces):
                assert (r.piece, r.first_token) == (i, at)
                at += r.n_tokens
            assert at == want[d]
            assert len(pieces) == max(1, -(-want[d] // cap))
    return rows


@pytest.mark.parametrize("block", [5, 4096])
def test_every_text_once(spark, block):
    r = random.Random(block)
    data = [(i, r.choice([None, "", "w", "token size " * r.randint(1, 200)])) for i in range(120)]
    check(spark, data, [(1, 16), (2, 64), (3, 1)], block_items=block)


def test_long_text_and_exact_fit(spark):
    rows = check(spark, [(1, "a " * 40_000), (2, "one two three four"), (3, "one two three four")], [(1, 4), (2, 8192)])
    assert {r.n_tokens for r in rows if r.doc_id == 2 and r.pack_id == 1} == {4}


def test_empty(spark):
    assert check(spark, [], [(1, 5)]) == []
    none = spark.createDataFrame([(1, None), (None, 5), (2, 0)], "pack_id int, capacity_tokens long")
    assert pack.pack(spark.createDataFrame([(1, "a", 0, 0)], DOCS), none).count() == 0


def test_little_room_is_lost():
    r = np.random.default_rng(3)
    sizes = r.integers(0, 513, 4096)
    box = pack.pack_block(sizes, 512)
    fill = np.bincount(box, weights=sizes)
    assert fill.max() <= 512 and sizes.sum() / (512 * len(fill)) > 0.97


def test_two_capacities_of_one_id(spark):
    with pytest.raises(ValueError):
        pack.capacities(spark.createDataFrame([(1, 5), (1, 6)], "pack_id int, capacity_tokens long"))
