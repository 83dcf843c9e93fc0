import re

import corpus_pipeline as P
import public_tokenizers
from test_chosenpath import brute as near_brute
from test_decontaminate import brute as bench_brute
from test_linededup import brute as line_brute
from tokenizers import Tokenizer

from quaymark.llm import langid

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    source = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 110 and length(text) < 4000")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "Привет мир как дела " * 30, "ru", "s", 0), (9004, source.first().text, None, None, None)], source.schema)
    docs = source.union(odd)
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    ids = list(rows)
    kept = {d: rows[d] for d, bad in zip(ids, model.nearest([rows[d] for d in ids])[2], strict=True) if not bad}
    stages = dict(P.STAGES)
    one = stages["language_id"](spark, docs, DATA)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == set(kept) and not {9001, 9002} & set(kept)

    after = {d: t for d, t in line_brute(list(kept.items()), 50) if t == kept[d] or re.search(r"\S", t)}
    two = stages["line_dedup"](spark, one, DATA)
    assert two.columns == docs.columns
    assert {r.doc_id: r.text for r in two.collect()} == after
    assert all(r.n_chars == len(r.text) for r in two.collect() if r.doc_id < 9000)

    single = {d for d, c, _ in near_brute(list(after.items())) if d == c}
    three = stages["near_duplicates"](spark, two, DATA)
    assert {r.doc_id for r in three.collect()} == single and three.columns == docs.columns

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in bench_brute([(d, after[d]) for d in single], bench) if not r[4]}
    four = stages["decontamination"](spark, three, DATA)
    assert {r.doc_id for r in four.collect()} == clean and four.columns == docs.columns

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["encoding"](spark, four, DATA).collect():
        want = lib.encode(after[r.doc_id], add_special_tokens=False).ids
        assert [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)] == want


def test_run(spark):
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    out = P.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 200


def test_run_on_odd_tables(spark, tmp_path):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = docs.where("length(text) between 300 and 2000").orderBy("doc_id").first().text
    odd = [(9001, text), (9001, text), (9002, text + " and more"), (None, None), (None, text), (9003, ""), (9004, "\n\n"), (9005, "longer words of a text " * 60_000)]
    many = docs.where("length(text) < 1000").select("doc_id", "text", "lang").union(spark.createDataFrame([(*o, "en") for o in odd], "doc_id bigint, text string, lang string"))
    for name, table in (("empty", docs.limit(0)), ("odd", many.selectExpr("doc_id", "text", "lang", "'x' as source", "7L as n_chars", "'a' as n_removed", "'b' as class_id", "'c' as ids", "'d' as score"))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "empty")).count() == 0
    source = spark.read.parquet(str(tmp_path / "odd/documents.parquet"))
    stage = source
    for _, function in P.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path / "odd"))
        assert stage.columns == source.columns
    rows = P.run(spark, str(tmp_path / "odd")).collect()
    assert len(rows) > 20 and not {9003, 9004} & {r.doc_id for r in rows}
    # Copies go; of the variant at most what no other text has stays.
    assert sum(r.doc_id == 9001 for r in rows) <= 1 and sum(r.doc_id is None for r in rows) <= 1 and len({r.ids_sha256 for r in rows}) == len(rows)
