"""Other tables in text files: cost matrices, ancestors, embeddings, feature triples, parameters, distributions,
knowledge bases, neighbour lists and lexical databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(line, name): lines of the files of a path, in order of file names and places, numbered from 0."""
    from tessera.operators.lexicon import number

    # Within one stretch of a file rows come in order, which the growing id keeps.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = spark.read.text(path).select(F.col("value").alias(name), place.alias("place"))
    return number(rows, "place", 0).select(F.col("idx").cast("long").alias("line"), name)


def read_cost_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(gold, pred, cost): a CSV with predicted names in its header and gold names in its first column, as long rows."""
    wide = spark.read.option("header", True).csv(path)
    first, *names = wide.columns
    rows = wide.select(F.col(f"`{first}`").alias("gold"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return rows.unpivot("gold", [f"`{n}`" for n in names], "pred", "cost").where("cost is not null")


def write_cost_matrix(costs: DataFrame, path: str) -> None:
    """The same as one CSV file of a row a gold name, in order of names, costs that are missing empty.

    The names of the columns are one row of the header, which is as wide as the file is to be; rows are put together from
    their own costs and that list, not on the driver.
    """
    quoted = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    names = costs.agg(F.array_sort(F.collect_set("pred")).alias("names"))
    by = costs.groupBy("gold").agg(F.map_from_entries(F.collect_set(F.struct("pred", "cost"))).alias("of"))
    cells = F.transform("names", lambda n: F.coalesce(F.try_element_at("of", n).cast("string"), F.lit("")))
    rows = by.join(F.broadcast(names)).select("gold", F.concat(quoted(F.col("gold")), F.lit(","), F.array_join(cells, ",")).alias("value"))
    head = names.select(F.lit(None).cast("string").alias("gold"), F.concat(F.lit("gold,"), F.array_join(F.transform("names", quoted), ",")).alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions(F.col("gold").asc_nulls_first()).select("value").write.text(path)


def read_ancestors(spark: SparkSession, path: str) -> DataFrame:
    """(frame, ancestor) from ragged rows ``frame,ancestor,...``."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", ",", 2).alias("p"))
    return parts.where(F.size("p") > 1).select(F.get("p", F.lit(0)).alias("frame"), F.explode(F.split(F.get("p", F.lit(1)), ",")).alias("ancestor")).where("ancestor <> ''")


def read_embeddings(spark: SparkSession, words: str, vectors: str) -> DataFrame:
    """(word, vector) from two files that belong together line by line."""
    both = _numbered(spark, words, "word").join(_numbered(spark, vectors, "v"), "line")
    return both.select(F.lower(F.trim("word")).alias("word"), F.split(F.trim("v"), r"\s+").cast("array<float>").alias("vector"))


def read_feature_triples(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, feature_name, value); a target's label is the row named ``frame``."""
    return spark.read.option("sep", "\t").schema("target_id long, feature_name string, value string").csv(path)


def write_feature_triples(df: DataFrame, path: str) -> None:
    df.select("target_id", "feature_name", "value").write.option("sep", "\t").csv(path)


def feature_maps(triples: DataFrame) -> DataFrame:
    """(target_id, frame, features: map) of each target."""
    rows = triples.where("feature_name <> 'frame'").groupBy("target_id", "feature_name").agg(F.sum(F.col("value").cast("double")).alias("v"))
    maps = rows.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_name", "v"))).alias("features"))
    return maps.join(triples.where("feature_name = 'frame'").select("target_id", F.col("value").alias("frame")), "target_id", "left")


def read_params(spark: SparkSession, path: str, kind: str = "named") -> DataFrame:
    """(feature, weight) of ``named`` lines (a header, then name and value by tab) or ``log`` lines (name, logarithm, sign);
    (idx, weight) of ``dense`` lines (a value each)."""
    lines = _numbered(spark, path, "value").where("value <> ''")
    part = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    if kind == "dense":
        return lines.select(F.col("line").alias("idx"), F.trim("value").cast("double").alias("weight"))
    rows = lines.where("line > 0") if kind == "named" else lines
    if kind == "named":
        return rows.select(part(0).alias("feature"), part(1).cast("double").alias("weight"))
    sign = F.when(part(2).isin("-", "-1", "false"), -1.0).otherwise(1.0)
    return rows.select(part(0).alias("feature"), (F.exp(part(1).cast("double")) * sign).alias("weight"))


def write_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def parse_distribution(lines: DataFrame) -> DataFrame:
    """(pred, frame, w) from (value) lines ``pred \\t f p f p ...``."""
    rows = lines.select(F.split("value", "\t").alias("s")).select(F.get("s", F.lit(0)).alias("pred"), F.split(F.trim(F.get("s", F.lit(1))), r"\s+").alias("f"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("f") - 2, F.lit(2)), lambda i: F.struct(F.get("f", i).alias("frame"), F.get("f", i + 1).cast("double").alias("w")))
    return rows.where(F.size("f") >= 2).select("pred", F.explode(pairs).alias("x")).select("pred", "x.*")


def distribution_lines(weights: DataFrame) -> DataFrame:
    """(value) lines, frames in order of name."""
    by = weights.groupBy("pred").agg(F.array_sort(F.collect_list(F.struct("frame", "w"))).alias("x"))
    return by.select(F.concat(F.col("pred"), F.lit("\t"), F.array_join(F.transform("x", lambda p: F.concat_ws(" ", p["frame"], p["w"].cast("string"))), " ")).alias("value"))


def parse_kb(lines: DataFrame, least: float = 0.91) -> DataFrame:
    """(phrase, type, conf) from (value) lines ``phrase \\t type:confidence ...``, only beyond the confidence, by phrase."""
    rows = lines.select(F.split("value", "\t").alias("s")).select(F.get("s", F.lit(0)).alias("phrase"), F.explode(F.split(F.trim(F.get("s", F.lit(1))), r"\s+")).alias("t"))
    rows = rows.select("phrase", F.regexp_extract("t", "^(.*):([^:]*)$", 1).alias("type"), F.expr("try_cast(regexp_extract(t, '^(.*):([^:]*)$', 2) as double)").alias("conf"))
    return rows.where(F.col("conf") > least).orderBy("phrase")


def parse_parents(lines: DataFrame) -> DataFrame:
    """(type, category) from (value) lines ``type \\t parent parent ...``; a type is its own category too."""
    rows = lines.select(F.split("value", "\t").alias("s")).select(F.get("s", F.lit(0)).alias("type"), F.split(F.trim(F.coalesce(F.get("s", F.lit(1)), F.lit(""))), r"\s+").alias("p"))
    return rows.select("type", F.explode(F.array_union(F.array("type"), "p")).alias("category")).where("category <> ''")


def read_neighbor_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(unit, line, position, nbr, sim) from records ``(unit (desc ... (nbr sim) ...))`` that end with ``))``."""
    records = spark.read.option("lineSep", "))").text(path).where(F.trim("value") != "")
    rows = records.select(F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value"))
    unit = F.regexp_extract("value", r"^\(\s*\"?([^\s\"()]+)\"?", 1)
    pairs = F.expr(r"""regexp_extract_all(value, '\\(?\\s*"?([^\\s"()]+)"?\\s+([0-9]*\\.[0-9]+)', 0)""")
    out = rows.select(unit.alias("unit"), "line", F.posexplode(pairs).alias("position", "p"))
    part = lambda i: F.regexp_extract("p", r"\(?\s*\"?([^\s\"()]+)\"?\s+([0-9]*\.[0-9]+)", i)
    return out.select("unit", "line", "position", part(1).alias("nbr"), part(2).cast("double").alias("sim"))


def read_lexical_tables(spark: SparkSession, folder: str, pos: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index: lemma, pos, synset), (senses: word, synset), (pointers: synset, fine, target), (exceptions: form, pos, base) of
    one part of speech of a lexical database in its text form; heading lines begin with blanks."""
    short = {"noun": "n", "verb": "v", "adj": "a", "adv": "r"}[pos]
    lines = lambda name: spark.read.text(f"{folder}/{name}").where(~F.col("value").startswith("  ") & (F.col("value") != ""))
    f = F.split(F.trim("value"), " ")
    idx = lines(f"index.{pos}").select(f.alias("f")).withColumn("n", F.get("f", F.lit(2)).cast("int"))
    idx = idx.select(F.replace(F.get("f", F.lit(0)), F.lit("_"), F.lit(" ")).alias("lemma"), F.lit(short).alias("pos"), F.explode(F.slice("f", F.size("f") - F.col("n") + 1, F.col("n"))).alias("synset"))
    data = lines(f"data.{pos}").select(F.split(F.trim(F.split_part("value", F.lit("|"), F.lit(1))), " ").alias("f"))
    data = data.withColumn("w", F.conv(F.get("f", F.lit(3)), 16, 10).cast("int")).withColumn("p", F.get("f", 4 + 2 * F.col("w")).cast("int"))
    synset = F.get("f", F.lit(0)).alias("synset")
    words = data.select(synset, F.explode(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.get("f", 4 + 2 * i))).alias("word"))
    senses = words.select(F.lower(F.replace(F.regexp_replace("word", r"\([a-z]+\)$", ""), F.lit("_"), F.lit(" "))).alias("word"), "synset")
    base = 5 + 2 * F.col("w")
    links = data.where("p > 0").select(
        synset, F.explode(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.get("f", base + 4 * i).alias("fine"), F.get("f", base + 4 * i + 1).alias("target")))).alias("x")
    )
    exceptions = lines(f"{pos}.exc").select(f.alias("f")).select(F.get("f", F.lit(0)).alias("form"), F.lit(short).alias("pos"), F.explode(F.slice("f", 2, F.size("f") - 1)).alias("base"))
    return idx, senses, links.select("synset", "x.*"), exceptions
