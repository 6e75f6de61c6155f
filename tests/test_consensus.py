"""Texts of several bidders: by hand, and against every pair of texts."""

import random

from tallyloom.operators import consensus


def test_by_hand(spark):
    rows = [(1, 1, "Cáp điện"), (1, 2, "cap dien"), (2, 1, "Tủ điện"), (2, 2, None), (3, 1, "Schneider"), (3, 2, "ABB"), (3, 3, "ABB"), (4, 1, "x"), (5, 1, ""), (5, 2, None), (7, 1, "x"), (7, 2, "y"), (7, 3, " "), (None, 1, "a"), (None, 2, "b"), (6, 1, "same"), (6, 1, "same")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "item long, bidder long, brand string, t__ string")
    got = {(r["item"], r["bidder"], r["brand"], r["kinds"], r["severity"], r["points"]) for r in consensus.text_consensus(df, "item", "bidder", "brand").collect()}
    assert got == {(2, 1, "Tủ điện", 1, "REVIEW", 4.0), (2, 2, "", 1, "REVIEW", 4.0), (3, 1, "Schneider", 2, "REVIEW", 4.0), (3, 2, "ABB", 2, "REVIEW", 4.0), (3, 3, "ABB", 2, "REVIEW", 4.0), *((7, b, t, 2, "REVIEW", 4.0) for b, t in ((1, "x"), (2, "y"), (3, "")))}
    assert consensus.text_consensus(df.limit(0), "item", "bidder", "brand").count() == 0


def test_against_pairs(spark):
    draw = random.Random(5)
    words = "cap dien dong boc pvc tu tong ong thep".split()
    rows = [(k % 12, k, " ".join(draw.sample(words, draw.randint(1, 3)))) for k in range(60)]
    want = {}
    for item in range(12):
        own = [(b, t) for i, b, t in rows if i == item]
        heads = []
        for _, t in own:
            if not any(consensus._alike(t, h) >= 0.88 for h in heads):
                heads.append(t)
        if len(heads) > 1:
            want |= {b: (len(heads), round(max([consensus._alike(t, h) for h in heads if h != t], default=0.0), 9)) for b, t in own}
    got = consensus.text_consensus(spark.createDataFrame(rows, "item long, bidder long, name string"), "item", "bidder", "name")
    assert {r["bidder"]: (r["kinds"], round(r["closest"], 9)) for r in got.collect()} == want
