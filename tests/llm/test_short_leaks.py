"""Documents shorter than a benchmark item."""

import random

from tessella.llm import decontaminate


def test_documents_shorter_than_an_item(spark):
    r = random.Random(12)
    item = [f"w{r.randrange(5000)}" for _ in range(60)]
    docs = [(1, item[:-1]), (2, item[1:]), (3, item[:50]), (4, item[:48]), (5, item[:30]), (6, item[:4]), (7, ["x", *item[:-2]]), (8, item), (9, ["x", *item, "y"])]
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "a b c d")], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.contaminated(frame, bench).collect()}
    assert sorted(got) == [1, 2, 3, 7, 8, 9]  # 46 and 44 of 56 shingles are 0.82 and 0.79
    assert got[1].n_words == 59 and got[1].start == 0 and abs(got[1].similarity - 55 / 56) < 1e-9
    assert got[9].n_words == 60 and got[9].start == 1
