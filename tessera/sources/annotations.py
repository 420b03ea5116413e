"""Frame annotations: tab-separated frame elements, nested JSON results, annotation and hierarchy XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
PARSE = (
    f"frames array<struct<target:struct<name:string,spans:array<{SPAN}>>,annotationSets:array<struct<rank:int,score:double,"
    f"frameElements:array<struct<name:string,spans:array<{SPAN}>>>>>>>, tokens array<string>"
)
GOLD = PARSE + ", " + ", ".join(f"{k} array<struct<name:string,start:int,end:int,text:string>>" for k in ("wsl", "ner", "pos"))
#: Labels of roles without words, and entity and relation names that scorers leave out.
EMPTY_ROLES = ("INI", "DNI", "CNI", "INC")
SKIPPED_RELATIONS = ("See_also", "CoreSet", "Excludes", "Requires")
LABELS = "labels struct<label:array<struct<_ID:long,_name:string,_start:int,_end:int,_itype:string>>>"
LAYERS = f"layers struct<layer:array<struct<_ID:long,_name:string,_rank:string,{LABELS.replace(' ', ':', 1)}>>>"
SENTENCE = f"_ID long, text string, annotationSets struct<annotationSet:array<struct<_ID:long,_frameName:string,_luName:string,{LAYERS.replace(' ', ':', 1)}>>>"


def parse_frame_elements(lines: DataFrame, column: str = "value") -> DataFrame:
    """(rank, score, count, frame, lu, target: ids array, target_text, sid, roles: array of (name, start, stop)), from lines
    of tab-separated fields; spans are ``a`` or ``a:b``, inclusive."""
    f = F.split(column, "\t")
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.select(f.alias("f"))
    pairs = F.when(F.size("f") >= 10, F.sequence(F.lit(8), F.size("f") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    bound = lambda i, last: F.element_at(F.split(F.get("f", i + 1), ":"), -1 if last else 1).cast("int")
    roles = F.transform(pairs, lambda i: F.struct(F.get("f", i).alias("name"), bound(i, False).alias("start"), bound(i, True).alias("stop")))
    return rows.select(
        at(0).cast("int").alias("rank"), at(1).cast("double").alias("score"), at(2).cast("int").alias("count"), at(3).alias("frame"), at(4).alias("lu"),
        F.split(at(5), "_").cast("array<int>").alias("target"), at(6).alias("target_text"), at(7).cast("long").alias("sid"), roles.alias("roles"),
    )


def read_frame_elements(spark: SparkSession, path: str) -> DataFrame:
    return parse_frame_elements(spark.read.text(path).where("value <> ''"))


def frame_element_lines(df: DataFrame) -> DataFrame:
    """(value) lines; ends are inclusive, one-word spans a single number, count is roles + 1."""
    span = lambda r: F.when(r["start"] == r["stop"], r["start"].cast("string")).otherwise(F.concat_ws(":", r["start"], r["stop"]))
    roles = F.flatten(F.transform("roles", lambda r: F.array(r["name"], span(r))))
    fields = ["rank", "score", F.size("roles") + 1, "frame", "lu", F.array_join(F.col("target").cast("array<string>"), "_"), "target_text", "sid"]
    texts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in fields]
    return df.select(F.concat_ws("\t", *[F.coalesce(t, F.lit("")) for t in texts], roles).alias("value"))


def parse_json(df: DataFrame) -> DataFrame:
    """(sid, value): one JSON object a sentence."""
    return df.select("sid", F.to_json(F.struct("frames", "tokens")).alias("value"))


def write_parse_json(df: DataFrame, path: str) -> None:
    """JSON lines in sentence order."""
    parse_json(df).orderBy("sid").select("value").write.text(path)


def read_parse_json(spark: SparkSession, path: str, gold: bool = False, first_only: bool = True) -> DataFrame:
    """(sid, frames, tokens, ...) of JSON lines; of several annotation sets scoring reads the first."""
    rows = spark.read.text(path).where("value <> ''").select(F.monotonically_increasing_id().alias("sid"), F.from_json("value", GOLD if gold else PARSE).alias("j")).select("sid", "j.*")
    if first_only:
        rows = rows.withColumn("frames", F.transform("frames", lambda f: f.withField("annotationSets", F.slice(f["annotationSets"], 1, 1))))
    return rows


def read_annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sid, text, frame, layer, rank, name, start, stop): labels with characters of sentences; roles of rank 1 or none,
    without those that have no words."""
    rows = spark.read.format("xml").option("rowTag", "sentence").schema(SENTENCE).load(path)
    sets = rows.select(F.col("_ID").alias("sid"), "text", F.explode("annotationSets.annotationSet").alias("s"))
    layers = sets.select("sid", "text", F.col("s._frameName").alias("frame"), F.col("s._ID").alias("set_id"), F.explode("s.layers.layer").alias("l"))
    labels = layers.select("sid", "text", "frame", "set_id", F.col("l._name").alias("layer"), F.coalesce("l._rank", F.lit("")).alias("rank"), F.explode("l.labels.label").alias("x"))
    labels = labels.where((F.col("layer") != "FE") | (F.col("rank").isin("", "1") & ~F.coalesce(F.upper("x._itype").isin(*EMPTY_ROLES), F.lit(False))))
    return labels.select("sid", "text", "frame", "set_id", "layer", "rank", F.col("x._name").alias("name"), F.col("x._start").alias("start"), F.col("x._end").alias("stop"))


def annotation_rows(predicted: DataFrame) -> DataFrame:
    """Nested rows for the annotation XML from (sid, text, frame, target_start, target_stop, roles) with characters;
    repeated target spans are dropped; set id = sid * 100 + k, layer id = set id * 100 + 1 and 2."""
    from pyspark.sql import Window

    once = predicted.dropDuplicates(["sid", "target_start", "target_stop"])
    k = F.row_number().over(Window.partitionBy("sid").orderBy("target_start", "target_stop", "frame")) - 1
    rows = once.withColumn("_ID", F.col("sid") * 100 + k)
    label = lambda name, a, b: F.struct(name.alias("_name"), a.alias("_start"), b.alias("_end"))
    target = F.array(label(F.lit("Target"), F.col("target_start"), F.col("target_stop")))
    roles = F.transform("roles", lambda r: label(r["name"], r["start"], r["stop"]))
    layer = lambda i, name, labels: F.struct((F.col("_ID") * 100 + i).alias("_ID"), F.lit(name).alias("_name"), F.struct(labels.alias("label")).alias("labels"))
    layers = F.struct(F.array(layer(1, "Target", target), layer(2, "FE", roles)).alias("layer")).alias("layers")
    sets = rows.groupBy("sid", "text").agg(F.array_sort(F.collect_list(F.struct("_ID", F.col("frame").alias("_frameName"), layers))).alias("a"))
    return sets.select(F.col("sid").alias("_ID"), "text", F.struct(F.col("a").alias("annotationSet")).alias("annotationSets"))


def write_annotation_xml(predicted: DataFrame, path: str) -> None:
    annotation_rows(predicted).orderBy("_ID").write.format("xml").option("rootTag", "sentences").option("rowTag", "sentence").save(path)


FRAME = "_name string, _ID long, fe array<struct<_name:string,_ID:long,_coreType:string>>, fes struct<fe:array<struct<_name:string,_ID:long,_coreType:string>>>"
RELATION = (
    "_name string, `frame-relations` struct<`frame-relation`:array<struct<_superFrameName:string,_subFrameName:string,"
    "`fe-relation`:array<struct<_superFEName:string,_subFEName:string>>>>>"
)


def read_hierarchy_xml(spark: SparkSession, frames: str, relations: str, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(edges: sup, sub, relation, kind; roles: frame, role, core_type); role nodes are ``frame;role``.

    ``skip`` leaves relations out, as scorers do with :data:`SKIPPED_RELATIONS`.
    """
    rows = spark.read.format("xml").option("rowTag", "frame").schema(FRAME).load(frames)
    fes = F.coalesce("fe", "fes.fe")
    roles = rows.select(F.col("_name").alias("frame"), F.explode(fes).alias("x")).select("frame", F.col("x._name").alias("role"), F.col("x._coreType").alias("core_type"))
    links = spark.read.format("xml").option("rowTag", "frame-relation-type").schema(RELATION).load(relations)
    links = links.where(~F.col("_name").isin(list(skip))) if skip else links
    links = links.select(F.col("_name").alias("relation"), F.explode("frame-relations.frame-relation").alias("r"))
    edge = links.select(F.col("r._superFrameName").alias("sup"), F.col("r._subFrameName").alias("sub"), "relation", F.lit("frame").alias("kind"))
    inner = links.where("r.`fe-relation` is not null").select("relation", "r", F.explode("r.fe-relation").alias("e"))
    name = lambda f, e: F.concat_ws(";", F.col(f"r.{f}"), F.col(f"e.{e}"))
    role_edge = inner.select(name("_superFrameName", "_superFEName").alias("sup"), name("_subFrameName", "_subFEName").alias("sub"), "relation", F.lit("role").alias("kind"))
    return edge.unionByName(role_edge), roles
