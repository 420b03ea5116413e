import zlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from tessera.llm.common import written


def test_stages_hold_together(spark, odd, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.select(*names)
    toxic = spark.createDataFrame([(10_000 + i, f"you idiot number {i} fool " * 9, "en", "a", 10) for i in range(40)], docs.schema)
    docs = docs.unionByName(toxic)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(10_000 + i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(18)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = written(f(spark, step, str(tmp_path)))
        assert step.columns == names
        kept.append(step)
    assert kept[0].where("doc_id >= 10000").count() == 0 and kept[0].count() == odd.count()
    assert kept[1].groupBy("text").count().where("count > 1").count() == 0
    assert kept[2].count() == kept[1].count()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for r in kept[3].collect():
        want[r["doc_id"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
    assert got == want


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_passages_of_over_fifty_words_go(spark):
    passage = [f"w{i}" for i in range(51)]
    own = lambda k: [f"own{k}{i}" for i in range(20)]
    texts = [" ".join([*own(k), *passage, *own(k + 1)]) for k in (10, 20)]
    texts += [" ".join([*own(k), *passage[:50], *own(k + 1)]) for k in (30, 40)]
    texts += [" ".join(own(50)) + "\n" + "  ".join(passage), None, "", "x" * 500, "x" * 500 + " y"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    assert len(" ".join(passage)) < 400
    assert [got[k].split() for k in (0, 1, 4)] == [own(10) + own(11), own(20) + own(21), own(50)]
    assert [got[k] for k in (2, 3)] == texts[2:4] and got[5] is None and got[6] == got[7] == "" and got[8] == " y"
