"""The registered queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402
from quern.llm import queries, toxicity  # noqa: E402
from tests.llm.test_operators import jaccard, plain_contamination, plain_secrets, sha, shingles  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, same, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", *(["text"])).collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append((before, docs.collect()))
    # toxicity: the documents that the operator's own query gives 0 stay
    before, after = kept[0]
    judged = toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in judged if not r["predicted"]} and len(after) < len(before)
    # near copies: of each group, by comparing the shingles of all pairs, the smallest id stays
    before, after = kept[1]
    sets = {i: shingles(t) for i, t in sorted(before.items()) if (t or "").split()}
    group = {i: i for i in before}
    for i in sets:
        for j in sets:
            if j < i and group[i] != group[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert {r["doc_id"] for r in after} == set(group.values()) and len(after) < len(before)
    # leaks: exactly the documents with a benchmark window go
    before, after = kept[2]
    assert {r["doc_id"] for r in after} == {i for i, t in before.items() if not plain_contamination(t, bench)[4]}
    # secrets: all documents stay, the base spans are gone
    before, after = kept[3]
    assert {r["doc_id"] for r in after} == set(before)
    for r in after:
        assert r["n_chars"] == len(r["text"])
        assert not [x for x in plain_secrets(r["text"]) if x[1]]
        if r["text"] != before[r["doc_id"]]:
            assert corpus_pipeline.REDACTED in r["text"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = kept[4]
    for r in after:
        ids = library.encode(before[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))


AWKWARD = [
    (1, "an ordinary text about gardens and winter", "en", "s", 41, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, " \n", "en", "s", 2, "x"),
    (None, "password = abcdefgh12345 in a row without an id", "en", "s", 1, "x"), (5, "token: ABCDEFGHIJKL\ttwo secret=1234567890 ones", None, "s", None, "x"),
    (6, "long words " * 30_000 + "é" * 5000, "en", "s", 1, "x"), (7, "one two three four five six seven eight nine ten eleven", "en", "s", 1, "x"),
    (8, "an ordinary text about gardens and winter", "de", "t", 41, "y"), (1, "an ordinary text about gardens and winter", "en", "s", 41, "x"),
]


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_pipeline_with_awkward_rows(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, {} string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "Two three, four five six seven eight nine ten ELEVEN"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema.format("fp0"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept.append(out.collect())
        if name != "bpe":
            assert out.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame([(*r, "clash") for r in kept[-1]], schema.format("spans"))
    if not rows:
        assert kept == [[]] * 5
        return
    ids = [sorted((r["doc_id"] for r in k), key=str) for k in kept]
    everything = sorted((r[0] for r in rows), key=str)
    assert ids[0] == everything  # nothing is learned from no labels
    assert ids[1] == sorted((r[0] for r in rows if r[0] != 8), key=str)  # rows of one id stay together
    assert ids[2] == ids[3] == ids[4] == [i for i in ids[1] if i != 7]
    text = {r["doc_id"]: r["text"] for r in kept[3]}
    assert text[None] == "[REDACTED] in a row without an id" and text[5] == "[REDACTED]\ttwo [REDACTED] ones"
    assert text[2] is None and text[3] == "" and text[6] == AWKWARD[6][1]
