"""Empty tables, repeated rows, null ids, long texts and columns that are called like the operators' own."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, images, language, licenses, near_copies, pieces, pitman_yor, secrets, simhash, suffixes

CLASH = "score", "_t", "fp", "row", "start", "kind", "item", "block", "place", "c", "n", "key", "id", "_c", "digest", "word", "class", "t", "d", "off", "_p"
LONG = "long words here " * 20_000 + "token = abcdefgh12345"


def docs(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH))) if clash else df


def leaks(df):
    bench = df.sparkSession.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (None, "only here")], "item_id long, text string")
    return decontaminate.contaminated(df, bench)


#: Operator, and whether it gives a row for each row.
OPERATORS = {
    "secrets": (secrets.scan, True),
    "suffixes": (suffixes.remove_repeats, True),
    "pieces": (lambda df: pieces.encode_decode(df, pieces.model_bytes()), True),
    "words": (pitman_yor.score, True),
    "language": (lambda df: language.identify(df, None, "doc_id"), True),
    "leaks": (leaks, False),
    "simhash": (simhash.near_duplicates, True),
    "copies": (near_copies.near_copies, False),
    "licences": (lambda df: licenses.scan(df, licenses.known_licenses(df.sparkSession)), True),
}
ROWS = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (None, "one two three four five six seven"), (None, None), (4, LONG)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, name):
    run, each = OPERATORS[name]
    assert run(docs(spark, []).limit(0)).count() == 0
    plain = run(docs(spark, ROWS))
    clash = run(docs(spark, ROWS, True))
    assert clash.columns == plain.columns
    got = sorted(map(str, plain.collect()))
    assert got == sorted(map(str, clash.collect()))
    if each:
        assert len(got) == len(ROWS)
        if name != "suffixes":  # of repeated rows the later one loses its bytes
            own = plain.where("doc_id = 3").collect()
            assert len(own) == 2 and own[0] == own[1]


def test_redaction_edges(spark):
    out = secrets.redact(docs(spark, ROWS, True))
    assert out.columns == ["doc_id", "text", *CLASH] and out.count() == len(ROWS)
    assert out.where("doc_id = 4").first().text.endswith("[SECRET]")
    assert secrets.redact(docs(spark, []).limit(0)).count() == 0


def test_leaks_of_odd_rows(spark):
    got = {(x.doc_id, x.item_id) for x in leaks(docs(spark, ROWS)).collect()}
    assert got == {(3, 1), (None, 1)}


def test_images_of_odd_rows(spark):
    schema = "image_id long, height int, width int, pixels binary, key string, class_id long, d int"
    flat = bytes(64 * 64)
    rows = [(None, 64, 64, flat, "k", 1, 2), (1, 64, 64, flat, "k", 1, 2), (1, 64, 64, flat, "k", 1, 2), (2, None, None, None, "k", 1, 2), (3, None, None, None, "k", 1, 2)]
    pairs, member = images.copies(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema))
    assert pairs.count() == 0 and member.count() == len(rows)
    assert {x.class_id for x in member.where("image_id > 1").collect()} == {2}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, tmp_path, empty):
    import corpus_pipeline as pipeline

    en = "the cat and the dog went to the house on the hill and saw that nothing was there "
    rows = [(k, f"{en} {k * 7919} {k * 104729} " + " ".join(f"w{k * j}" for j in range(40)), "en") for k in range(1, 30)]
    rows += [(5, rows[4][1], "en"), (5, rows[4][1], "en"), (None, rows[6][1], "en"), (None, None, "en"), (40, None, None), (41, LONG, "en")]
    names = ["lang_pred", "score", "id", "t", "row", "_c", "start", "item"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit(1).alias(c) for c in names))
    df = df.limit(0) if empty else df
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        assert k == len(pipeline.STAGES) - 1 or out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{k}")
        table = spark.read.parquet(f"{tmp_path}/{k}")
    ids = [r.doc_id for r in table.collect()]
    assert ids == [] if empty else set(ids) == {*range(1, 30), 41, None} and ids.count(5) == 3 and ids.count(None) == 1
