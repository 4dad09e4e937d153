"""The pipeline's stages against the single operators on the same input."""

import corpus_pipeline as P
from sparquarry.llm.decontamination import contamination
from sparquarry.llm.minhash import near_duplicates
from sparquarry.llm.mixing import mixture


def test_stages(spark, sf):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = P.drop_toxic(spark, docs, sf)
    assert one.columns == P.COLUMNS and 0.7 * docs.count() < one.count() < docs.count()
    two = P.drop_near_copies(spark, docs, sf)
    assert {r[0] for r in two.select("doc_id").collect()} == {r[0] for r in near_duplicates(docs, 5).where("kept").select("doc_id").collect()}
    three = P.drop_leaks(spark, docs, sf)
    assert {r[0] for r in three.select("doc_id").collect()} == {r[0] for r in contamination(docs, benchmark).where("kept").select("doc_id").collect()}
    four = P.mix(spark, docs, sf)
    assert four.columns == P.COLUMNS
    words = lambda df: sum(len((r[0] or "").split()) for r in df.select("text").collect())
    assert abs(words(four) - words(docs)) < 40
    five = P.write_tokens(spark, docs, sf)
    assert five.count() == docs.count() and five.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


AWKWARD = [
    (1, None, "en", "a"), (2, "", None, None), (None, "a text without an id", "en", "a"), (None, "a text without an id", "en", "a"), (3, "w " * 30_000, "de", "b"),
    (4, "one two three four five six seven eight", "en", "a"), (4, "one two three four five six seven eight", "en", "a"), (4, "quite other words under an id that was there before", "en", "b"),
    (5, "one two three four five six seven eight", "en", None), (6, "\n", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, row string, id string, version string, kept string, toxic string, v string"


def awkward(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 8) for r in rows], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"] or -1, r["text"] or "") for r in df.collect()))


def test_stages_on_awkward_rows(spark, sf):
    docs = awkward(spark, AWKWARD)
    for _, stage in P.STAGES:
        assert stage(spark, awkward(spark, []), sf).count() == 0
    assert P.drop_toxic(spark, docs, sf).columns == P.COLUMNS
    near = texts(P.drop_near_copies(spark, docs, sf))
    # Document 5 is a copy of 4; the repeated row of 4 goes, its other text stays, and so do rows without an id.
    assert near == sorted((r[0] or -1, r[1] or "") for i, r in enumerate(AWKWARD) if i not in (6, 8))
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first()["text"]
    mixed_in = awkward(spark, [*AWKWARD, (4, leak, "en", "a"), (None, leak, "en", "a")])
    # Only the rows with the passage go, not others under their id.
    assert texts(P.drop_leaks(spark, mixed_in, sf)) == texts(docs)
    taken = P.mix(spark, docs, sf).collect()
    want = {}
    for r in mixture(docs, keep=["text"]).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in taken:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: n for k, n in want.items() if n}
    assert P.write_tokens(spark, docs, sf).count() == len(AWKWARD)


def test_run(spark, sf):
    got = P.run(spark, sf).collect()
    ids = [r["doc_id"] for r in got]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(ids) <= {r[0] for r in docs.select("doc_id").collect()} and ids == sorted(ids)
    starts = [r["start"] for r in got]
    assert starts == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))] and len(set(ids)) > 0.5 * docs.count()
