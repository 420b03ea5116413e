"""Readers and writers on small inline files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources import annotations, tables, tagged


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


CONLL = "1\tA\ta\tDT\tDT\t_\t2\tdet\t_\t_\n2\tdog\tdog\tNN\tNN\t_\t3\tsubj\t_\t_\n3\tran\trun\tVBD\tVBD\t_\t0\troot\t_\t_\n\n7\tGo\tgo\tVB\tVB\t_\t0\troot\t_\t_\nbad line\n"


def test_conll_records_nulls_ids_and_bad_lines(spark, tmp_path):
    good, bad = tagged.read_conll(spark, put(tmp_path, "a.conll", CONLL))
    got = rows(good.select("id", "form", "feats", "head", "deprel"), "sid", "id")
    assert got == [(1, "A", None, 2, "det"), (2, "dog", None, 3, "subj"), (3, "ran", None, 0, "root"), (1, "Go", None, 0, "root")]
    assert [r["line"] for r in bad.collect()] == ["bad line"]


def test_formats_convert_into_each_other(spark, tmp_path):
    source = put(tmp_path, "a.conll", CONLL.replace("bad line\n", ""))
    want = {"pos": ["A_DT dog_NN ran_VBD", "Go_VB"], "malt": ["A/DT/2/det dog/NN/3/subj ran/VBD/0/root", "Go/VB/0/root"], "tokenized": ["A dog ran", "Go"]}
    for fmt, lines in want.items():
        tagged.convert_format(spark, source, "conll", str(tmp_path / fmt), fmt)
        assert [r[0] for r in spark.read.text(str(tmp_path / fmt)).collect()] == lines
        again = tagged.READERS[fmt](spark, str(tmp_path / fmt))
        assert sorted(r["form"] for r in again.collect()) == ["A", "Go", "dog", "ran"]
    tagged.convert_format(spark, source, "conll", str(tmp_path / "c"), "conll")
    assert tagged.read_conll(spark, str(tmp_path / "c"))[0].drop("sid").exceptAll(tagged.read_conll(spark, source)[0].drop("sid")).count() == 0


def test_last_underscore_and_trailing_number(spark, tmp_path):
    assert rows(tagged.read_pos_tagged(spark, put(tmp_path, "p", "a_b_NN 1/2_CD\n")).select("form", "postag"), "id") == [("a_b", "NN"), ("1/2", "CD")]
    assert rows(tagged.read_malt(spark, put(tmp_path, "m", "1/2/CD/0/root\t17\n")).select("form", "head", "deprel"), "id") == [("1/2", 0, "root")]


def test_all_lemma_tags_round_trip(spark, tmp_path):
    line = "2\tDogs\tran\tNNS\tVBD\tsubj\troot\t2\t0\tO\tO\tdog\trun"
    tokens = tagged.read_all_lemma_tags(spark, put(tmp_path, "t", line + "\n"))
    assert rows(tokens.select("id", "form", "lemma", "postag", "head", "deprel"), "id") == [(1, "Dogs", "dog", "NNS", 2, "subj"), (2, "ran", "run", "VBD", 0, "root")]
    assert tagged.all_lemma_tags(tokens).first()["value"] == line


def test_slice_lines_is_by_order(spark):
    df = spark.range(100).select(F.col("id").alias("sid")).repartition(7)
    assert [r[0] for r in tagged.slice_lines(df, 10, 14).orderBy("sid").collect()] == [10, 11, 12, 13]


def test_frame_elements_round_trip(spark):
    lines = ["1\t0.5\t3\tMotion\tgo.v\t2_3\tgo on\t7\tTheme\t0:1\tGoal\t4", "0\t1.0\t1\tEvent\thappen.v\t1\thappens\t8"]
    df = annotations.parse_frame_elements(spark.createDataFrame([(x,) for x in lines], "value string"))
    first = df.where("sid = 7").first()
    assert first["target"] == [2, 3] and [tuple(r) for r in first["roles"]] == [("Theme", 0, 1), ("Goal", 4, 4)]
    assert sorted(r[0] for r in annotations.frame_element_lines(df).collect()) == sorted(lines)


XML = """<corpus><documents><document><paragraphs><paragraph><sentences><sentence ID="3"><text>Dogs ran home</text><annotationSets>
<annotationSet ID="300" frameName="Motion"><layers><layer ID="30001" name="Target"><labels><label ID="1" name="Target" start="5" end="7"/></labels></layer>
<layer ID="30002" name="FE" rank="1"><labels><label ID="2" name="Theme" start="0" end="3"/><label ID="3" name="Goal" itype="INI"/></labels></layer>
<layer ID="30003" name="FE" rank="2"><labels><label ID="4" name="Path" start="9" end="12"/></labels></layer></layers></annotationSet>
</annotationSets></sentence></sentences></paragraph></paragraphs></document></documents></corpus>"""


def test_annotation_xml_reads_and_writes(spark, tmp_path):
    df = annotations.read_annotation_xml(spark, put(tmp_path, "a.xml", XML))
    assert rows(df.select("sid", "frame", "layer", "name", "start", "stop"), "layer", "start") == [(3, "Motion", "FE", "Theme", 0, 3), (3, "Motion", "Target", "Target", 5, 7)]
    made = spark.createDataFrame([(3, "Dogs ran home", "Motion", 5, 7, [("Theme", 0, 3)]), (3, "Dogs ran home", "Copy", 5, 7, [])], "sid long, text string, frame string, target_start int, target_stop int, roles array<struct<name:string,start:int,stop:int>>")
    annotations.write_annotation_xml(made, str(tmp_path / "out"))
    again = annotations.read_annotation_xml(spark, str(tmp_path / "out"))
    assert again.where("layer = 'Target'").count() == 1


def test_hierarchy_xml(spark, tmp_path):
    frames = put(tmp_path, "f.xml", '<frames><frame name="A" ID="1"><fe name="x" ID="2" coreType="Core"/><fe name="y" ID="3" coreType="Peripheral"/></frame></frames>')
    rel = '<frame-relations><frame-relation-type name="Inheritance"><frame-relations><frame-relation superFrameName="A" subFrameName="B"><fe-relation superFEName="x" subFEName="z"/></frame-relation></frame-relations></frame-relation-type>'
    rel += '<frame-relation-type name="See_also"><frame-relations><frame-relation superFrameName="A" subFrameName="C"/></frame-relations></frame-relation-type></frame-relations>'
    path = put(tmp_path, "r.xml", rel)
    edges, roles = annotations.read_hierarchy_xml(spark, frames, path)
    assert rows(edges, "kind", "sub") == [("A", "B", "Inheritance", "frame"), ("A", "C", "See_also", "frame"), ("A;x", "B;z", "Inheritance", "role")]
    assert rows(roles, "role") == [("A", "x", "Core"), ("A", "y", "Peripheral")]
    assert annotations.read_hierarchy_xml(spark, frames, path, annotations.SKIPPED_RELATIONS)[0].count() == 2


def test_tables(spark, tmp_path):
    assert rows(tables.read_ancestors(spark, put(tmp_path, "anc.csv", "Text,Entity,Artifact\nAlone\n")), "ancestor") == [("Text", "Artifact"), ("Text", "Entity")]
    vec = tables.read_embeddings(spark, put(tmp_path, "w", "The\ndog\n"), put(tmp_path, "v", "0.5 1\n2 3\n"))
    assert {r["word"]: r["vector"] for r in vec.collect()} == {"the": [0.5, 1.0], "dog": [2.0, 3.0]}
    assert rows(tables.read_params(spark, put(tmp_path, "p", "extractor\nf\t0.25\n")), "feature") == [("f", 0.25)]
    log = tables.read_params(spark, put(tmp_path, "l", "g\t0.0\t-\nh\t0.0\t+\n"), "log")
    assert rows(log, "feature") == [("g", -1.0), ("h", 1.0)]
    assert rows(tables.read_params(spark, put(tmp_path, "d", "0.5\n-1\n"), "dense"), "idx") == [(0, 0.5), (1, -1.0)]
    dist = tables.parse_distribution(spark.createDataFrame([("run.v\tA 0.5 B 0.25",)], "value string"))
    assert rows(dist, "frame") == [("run.v", "A", 0.5), ("run.v", "B", 0.25)]
    assert tables.distribution_lines(dist).first()[0] == "run.v\tA 0.5 B 0.25"
    kb = tables.parse_kb(spark.createDataFrame([("new york\tcity:0.95 state:0.5",)], "value string"))
    assert rows(kb, "type") == [("new york", "city", 0.95)]
    parents = tables.parse_parents(spark.createDataFrame([("city\tplace thing",), ("alone",)], "value string"))
    assert rows(parents, "type", "category") == [("alone", "alone"), ("city", "city"), ("city", "place"), ("city", "thing")]
    triples = spark.createDataFrame([(1, "frame", "A"), (1, "bias", "1.0"), (1, "x", "2")], "target_id long, feature_name string, value string")
    tables.write_feature_triples(triples, str(tmp_path / "t"))
    back = tables.feature_maps(tables.read_feature_triples(spark, str(tmp_path / "t"))).first()
    assert back["frame"] == "A" and back["features"] == {"bias": 1.0, "x": 2.0}


def test_neighbor_blocks(spark, tmp_path):
    text = '("alpha" (desc 1.0)\n("beta" 0.5)\n(gamma 0.25))\n("delta" (desc 1.0)\n("alpha" 0.75))\n'
    got = tables.read_neighbor_blocks(spark, put(tmp_path, "n", text))
    assert {(r["unit"], r["nbr"], r["sim"]) for r in got.collect() if r["nbr"] != "desc"} == {("alpha", "beta", 0.5), ("alpha", "gamma", 0.25), ("delta", "alpha", 0.75)}


def test_lexical_tables(spark, tmp_path):
    put(tmp_path, "index.noun", "  1 licence\ndog n 2 1 @ 2 0 00000010 00000020  \nhot_dog n 1 0 1 0 00000020  \n")
    put(tmp_path, "data.noun", "  1 licence\n00000010 05 n 01 dog 0 001 @ 00000020 n 0000 | an animal\n00000020 05 n 02 dog 0 Hot_dog 1 000 | food\n")
    put(tmp_path, "noun.exc", "geese goose\nmen man\n")
    index, senses, pointers, exceptions = tables.read_lexical_tables(spark, str(tmp_path), "noun")
    assert rows(index, "lemma", "synset") == [("dog", "n", "00000010"), ("dog", "n", "00000020"), ("hot dog", "n", "00000020")]
    assert rows(senses, "synset", "word") == [("dog", "00000010"), ("dog", "00000020"), ("hot dog", "00000020")]
    assert rows(pointers, "synset") == [("00000010", "@", "00000020")]
    assert rows(exceptions, "form") == [("geese", "n", "goose"), ("men", "n", "man")]


def test_synsets_of_over_255_words_keep_all(spark, tmp_path):
    from tessera.plans import source_queries

    spark.range(1, 701).selectExpr("id as p_partkey", "'Brand#1' || (id % 2) as p_brand", "cast(id % 5 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    rows = source_queries.q_lexical_tables(spark, str(tmp_path))
    assert {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"index": 700, "sense": 700, "pointer @": 2, "exception": 280}
