"""Chat formatting, images, the pipeline and the queries with SQL."""

import hashlib
import json

import numpy as np
import pytest
from oracle import connect, same

from tessella.llm import chat, images, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


ROWS = [
    (1, None, None, None), (1, 0, "user", "\\</s>\\\\[INST]<s"), (1, 1, "assistant", "<\\/s>\\e</s><s>[/INST]\n[INST"), (2, 0, "a[INST]b\\", "x" * 50_000),
    (None, 0, "assistant", ""), (3, 1, "assistant", "q"), (3, 1, "assistant", "q"), (4, 2, "user", "é😀<"), (4, 2, "assistant", "/s>"),
]


def test_formatting_reads_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, messages string")
    out = chat.format_conversations(df).withColumn("back", chat.read_back()).withColumn("loss", chat.masked_text()).collect()
    assert len(out) == 5
    for x in out:
        own = sorted(((t if t is not None else -1, r or "", v or "") for c, t, r, v in ROWS if c == x.conv_id), key=lambda y: y)
        assert [tuple(t) for t in x.back] == [(r, v) for _, r, v in own]
        assert x.loss == "".join(v for _, r, v in own if r == "assistant")
        assert [x.formatted[s.start : s.end] for s in x.loss_mask] == [v.replace("\\", "\\\\").replace("</s>", "<\\/s>").replace("<s>", "<\\s>").replace("[/INST]", "[\\/INST]").replace("[INST]", "[\\INST]") for _, r, v in own if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    given = [
        ({"prompt": "p", "response": "r", "id": 4}, "prompt-response", [("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "r"}, "prompt-completion", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction-input-output", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction-input-output", [("user", "i\nn"), ("assistant", "o")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"system": "S", "messages": [{"role": "user", "content": "c"}]}, "system-messages", [("system", "S"), ("user", "c")]),
        ({"question": "q", "answer": "a"}, "question-answer", [("user", "q"), ("assistant", "a")]),
        ({"other": 1}, None, None), ({}, None, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(g[0])) for k, g in enumerate(given)] + [(99, None), (98, "{broken")], "k long, j string")
    out = {x.k: x for x in chat.canonical(chat.parse_records(df, "j", "k")).collect()}
    for k, (_, layout, turns) in enumerate(given):
        assert out[k].layout == layout and (out[k].turns and [tuple(t) for t in out[k].turns]) == turns
    assert out[99].turns is None and out[98].turns is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])


def picture(seed, n=64):
    return images._resize(np.random.default_rng(seed).integers(0, 256, (1, n // 2, n // 2)).astype(np.float32), 0.5)[0].astype(np.uint8)


def test_cropped_and_edited_copies(spark):
    schema = "image_id long, height int, width int, pixels binary"
    pack = lambda k, a: (k, *a.shape, a.tobytes())
    stored = [pack(k, picture(k)) for k in range(40)] + [pack(100, picture(3)), (101, None, None, None), (102, 3, 3, b"123456789"), (103, 5, 5, b"x"), (104, 0, 0, b"")]
    asked = [pack(200 + k, (picture(k)[5:60, 7:58] * 0.7 + 30).astype(np.uint8)) for k in range(10)] + [pack(300 + k, np.rot90(picture(k)).copy()) for k in range(5)] + [pack(400, picture(999))]
    pairs, member = images.copies(spark.createDataFrame(asked, schema), spark.createDataFrame(stored, schema))
    got = {(x.query_id, x.class_id) for x in pairs.collect()}
    assert sum((200 + k, k) in got for k in range(10)) >= 9 and sum((300 + k, k) in got for k in range(5)) >= 4
    assert all(b == a % 100 for a, b in got)
    classes = {x.image_id: x.class_id for x in member.collect()}
    assert classes[100] == 3 and classes[101] == 101 and len(classes) == 45
    empty = spark.createDataFrame([], schema)
    assert images.copies(empty, empty)[0].count() == 0


EDITS = {
    "crop": lambda a, r: a[6:58, 4:60],
    "contrast": lambda a, r: (a * 0.6 + 50).astype(np.uint8),
    "noise": lambda a, r: np.clip(a + r.normal(0, 4, a.shape), 0, 255).astype(np.uint8),
    "quarter turn": lambda a, r: np.rot90(a).copy(),
    "smaller": lambda a, r: images._resize(a[None].astype(np.float32), 1.5)[0].astype(np.uint8),
    "crop and noise": lambda a, r: np.clip(a[5:60, 3:58] + r.normal(0, 3, a[5:60, 3:58].shape), 0, 255).astype(np.uint8),
}


def all_descriptors(asked, stored):
    """Pairs of all images whose corners agree, with every descriptor held against every other."""

    def corners(a):
        return images.describe(a[None])

    known = {k: corners(a) for k, a in stored.items()}
    out = set()
    for q, a in asked.items():
        _, y1, x1, s1, r1, d1 = corners(a)
        for c, (_, y2, x2, s2, r2, d2) in known.items():
            near = np.bitwise_count((d1[:, None] ^ d2[None]).view(np.uint64)).sum(axis=2) <= images.RADIUS
            i, j = np.nonzero(near)
            if not len(i):
                continue
            turn, grow = (r2[j] - r1[i]) * (2 * np.pi / images.TURNS), s2[j] / s1[i]
            ty = y2[j] - grow * (np.cos(turn) * y1[i] - np.sin(turn) * x1[i])
            tx = x2[j] - grow * (np.sin(turn) * y1[i] + np.cos(turn) * x1[i])
            octave, eighth = np.rint(2 * np.log2(grow)), np.mod(np.rint((r2[j] - r1[i]) * 8 / images.TURNS), 8)
            votes: dict = {}
            for a_ in (0, 1):
                for b_ in (0, 1):
                    cells = zip(octave, eighth, np.floor(ty / images.CELL + a_ / 2), np.floor(tx / images.CELL + b_ / 2), y1[i], x1[i], s1[i])
                    for o, e, u, v, *corner in cells:
                        votes.setdefault((a_, b_, o, e, u, v), set()).add(tuple(corner))
            if max(map(len, votes.values())) >= images.VOTES:
                out.add((q, c))
    return out


@pytest.mark.parametrize("edit", sorted(EDITS))
def test_copies_against_all_descriptors(spark, edit):
    r = np.random.default_rng(11)
    stored = {k: picture(k) for k in range(30)}
    asked = {200 + k: EDITS[edit](stored[k], r) for k in range(30)}
    schema = "image_id long, height int, width int, pixels binary"
    df = lambda rows: spark.createDataFrame([(k, *a.shape, np.ascontiguousarray(a).tobytes()) for k, a in rows.items()] * 2, schema)  # noqa: E731  every row twice
    got = {(x.query_id, x.class_id) for x in images.copies(df(asked), df(stored))[0].collect()}
    want = all_descriptors(asked, stored)
    true = {(200 + k, k) for k in range(30)}
    print(edit, "found", len(got & true), "by all descriptors", len(want & true), "of", len(true))
    assert got <= want and len(got) >= 0.9 * len(want) and want <= true


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    en = "the cat and the dog went to the house on the hill and saw that nothing was there "
    de = "der Hund und die Katze gingen zu dem Haus auf dem Berg und sahen dass nichts da war "
    bench = "one question about seven green apples that nobody has ever asked before in this town"
    docs = [(k, f"{en if k % 2 else de}{k * 7919} {k * 104729} " + " ".join(f"{en.split()[(k * j) % 17]}{j * k}" for j in range(60)), "en" if k % 2 else "de", "s", 1) for k in range(1, 60)]
    docs += [(100, docs[3][1], "de", "s", 1), (101, f"{en} 77 88 {bench} {en[::-1]}", "en", "s", 1), (102, f"{en} the token = abcdef123456 {de}", "en", "s", 1), (103, None, "en", "s", 1), (104, "123 456", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        table = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({x.doc_id: x for x in table.collect()})
        if name != pipeline.STAGES[-1][0]:
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = {d[0] for d in docs}
    assert set(seen[0]) == every - {103, 104}
    assert set(seen[1]) == set(seen[0]) - {100}
    assert set(seen[2]) == set(seen[1]) - {101}
    assert set(seen[3]) == set(seen[2]) and "[SECRET]" in seen[3][102].text and "abcdef123456" not in seen[3][102].text
    assert seen[3][102].n_chars == len(seen[3][102].text)
    assert {k: x.decoded for k, x in seen[4].items()} == {k: x.text for k, x in seen[3].items()}
    assert {x.doc_id for x in pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4])
