"""Lexicon, word relations, similarity graphs and distributions over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Exact pointer types of the lexical database and the relation each belongs to.
RELATIONS = {
    "synm": "synonym", "syn2": "synonym", "antm": "antonym", "extd": "antonym", "indi": "antonym", "hype": "hypernym", "hypo": "hyponym",
    "mero": "meronym", "holo": "holonym", "entl": "entailment", "caus": "cause", "deri": "derivation", "attr": "attribute", "iden": "identity",
}


def invert_lexicon(units: DataFrame) -> DataFrame:
    """(lemmas, frames) from (frame, lemmas): every lemma string with the frames it may evoke."""
    return units.groupBy("lemmas").agg(F.array_sort(F.collect_set("frame")).alias("frames"))


def unit_lemmas(units: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Distinct (form, pos, lemma) of the words of units (frame, unit), unit being ``w1_POS w2_POS``."""
    words = units.select(F.explode(F.split("unit", " ")).alias("w"))
    words = words.select(F.regexp_extract("w", "^(.*)_([^_]*)$", 1).alias("form"), F.regexp_extract("w", "^(.*)_([^_]*)$", 2).alias("pos")).distinct()
    return words.join(lemmas, ["form", "pos"], "left").select("form", "pos", F.coalesce("lemma", F.lower("form")).alias("lemma"))


def _plain(words: DataFrame, stop_words: DataFrame) -> DataFrame:
    return words.join(stop_words, "word", "left_anti").where(F.col("word").rlike("[A-Za-z0-9]") & (F.size(F.split("word", " ")) <= 4))


def related_words(words: DataFrame, senses: DataFrame, pointers: DataFrame, stop_words: DataFrame, synonyms: bool = True) -> DataFrame:
    """(word, fine, related) for each word: itself; the other words of its senses; words that pointers lead to; and
    its inflections by pattern. Stop words, punctuation and inputs of over four words have the identity only.

    ``senses`` is (word, synset), ``pointers`` (synset, fine, target). Without ``synonyms`` the words of its senses are left out.
    """
    identity = words.select("word", F.lit("iden").alias("fine"), F.col("word").alias("related"))
    plain = _plain(words, stop_words)
    mine = plain.join(senses, "word").select("word", "synset")
    others = senses.select(F.col("word").alias("related"), F.col("synset").alias("target"))
    same = mine.withColumnRenamed("synset", "target").join(others, "target").where("word <> related").select("word", F.lit("synm").alias("fine"), "related")
    linked = mine.join(pointers, "synset").join(others, "target").select("word", "fine", "related")
    w = F.col("word")
    stem = F.expr("substring(word, 1, length(word) - 1)")
    forms = F.array_distinct(
        F.concat(
            F.array(F.concat(w, F.lit("s")), F.concat(w, F.lit("es")), F.concat(w, F.lit("ing")), F.concat(w, F.lit("ed"))),
            F.when(w.endswith("y"), F.array(F.concat(stem, F.lit("ies")))).otherwise(F.array().cast("array<string>")),
            F.when(w.endswith("e"), F.array(F.concat(w, F.lit("d")), F.concat(w, F.lit("r")), F.concat(stem, F.lit("ing")))).otherwise(F.array(F.concat(w, F.lit("er")))),
        )
    )
    inflected = plain.where(~w.contains(" ")).select("word", F.lit("deri").alias("fine"), F.explode(forms).alias("related"))
    found = identity.unionByName(linked).unionByName(inflected)
    return (found.unionByName(same) if synonyms else found).distinct()


#: Relations that not only senses and pointers lead to.
OWN = ["identity", "same-number", "derivation"]


def relation_counts(words: DataFrame, senses: DataFrame, pointers: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(word, relation, n): how many related words :func:`collapse_relations` gives each word, without making the pairs.

    A word of one sense has what its sense has, so that senses are counted: of words with one sense a target sense has
    a number, those with several are told apart by name. Pairs are made only for words with several senses or none, and
    for relations that come from elsewhere too.
    """
    words, senses = words.select("word").distinct(), senses.select("word", "synset").distinct()
    names = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    named = pointers.withColumn("relation", F.coalesce(F.element_at(names, F.col("fine")), F.col("fine")))
    by_word = senses.groupBy("word").agg(F.count("*").alias("k"), F.min("synset").alias("synset"))
    single = by_word.where("k = 1").select("word", "synset")
    several = by_word.where("k > 1").select("word").join(senses, "word").select(F.col("synset").alias("target"), F.col("word").alias("other"))
    # A sense's own words are its synonyms, all but the word itself, unless a pointer leads back.
    own = senses.select("synset").distinct().select("synset", F.lit("synonym").alias("relation"), F.col("synset").alias("target"), F.lit(1).alias("less"))
    links = named.where(~F.col("relation").isin(OWN)).select("synset", "relation", "target", F.lit(0).alias("less"))
    links = links.unionByName(own).groupBy("synset", "relation", "target").agg(F.min("less").alias("less"))
    sizes = single.groupBy(F.col("synset").alias("target")).agg(F.count("*").alias("size"))
    alone = links.join(sizes, "target").select("synset", "relation", (F.col("size") - F.col("less")).alias("n"))
    others = links.join(several, "target").select("synset", "relation", "other").distinct().groupBy("synset", "relation").agg(F.count("*").alias("n"))
    sums = alone.unionByName(others).groupBy("synset", "relation").agg(F.sum("n").alias("n")).where("n > 0")
    simple = _plain(words, stop_words).join(single, "word")
    counted = simple.join(sums, "synset").select("word", "relation", "n")
    rest = words.join(single, "word", "left_anti")
    of_rest = related_words(rest, senses, pointers, stop_words)
    special = named.where(F.col("relation").isin(OWN)).drop("relation")
    of_single = related_words(words.join(single, "word", "left_semi"), senses, special, stop_words, synonyms=False)
    pairs = collapse_relations(of_rest.unionByName(of_single)).groupBy("word", "relation").agg(F.count("*").alias("n"))
    return counted.unionByName(pairs)


def collapse_relations(related: DataFrame) -> DataFrame:
    """(word, relation, related): fine types under their names; numbers are alike when the word begins with a digit."""
    names = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    number = F.col("word").rlike("^[0-9]") & F.col("related").rlike("^[0-9]") & (F.col("fine") == "iden")
    return related.select("word", F.when(number, "same-number").otherwise(F.coalesce(F.element_at(names, F.col("fine")), F.col("fine"))).alias("relation"), "related").distinct()


def relations_between(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sorted array of relations of b among a's related words, else ``no-relation``.

    Pairs are made distinct before the lookup, as the same words meet often.
    """
    found = pairs.select("a", "b").distinct().join(relations.select(F.col("word").alias("a"), F.col("related").alias("b"), "relation"), ["a", "b"])
    found = found.groupBy("a", "b").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    return pairs.join(found, ["a", "b"], "left").withColumn("relations", F.coalesce("relations", F.array(F.lit("no-relation"))))


def rekey_relations(relations: DataFrame) -> DataFrame:
    """(word, related, relations) from (word, relation, related)."""
    return relations.groupBy("word", "related").agg(F.array_sort(F.collect_set("relation")).alias("relations"))


def graph_top_t(graph: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """(pred, frames) and (word, frames): the first t frames of each predicate ``word.pos`` by position; of a word over
    all parts of speech."""
    order = Window.partitionBy("pred").orderBy("position", "frame")
    top = graph.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= t)
    fine = top.groupBy("pred").agg(F.array_sort(F.collect_set("frame")).alias("frames"))
    coarse = top.groupBy(F.regexp_replace("pred", r"\.[^.]*$", "").alias("word")).agg(F.array_sort(F.collect_set("frame")).alias("frames"))
    return fine, coarse


def normalize_distribution(weights: DataFrame) -> DataFrame:
    """(pred, frame, p): weights as shares of their predicate's sum, joined back so that no predicate needs a window."""
    sums = weights.groupBy("pred").agg(F.sum("w").alias("_sum"))
    return weights.join(sums, "pred").select("pred", "frame", F.try_divide("w", "_sum").alias("p"))


def expand_distribution(train: DataFrame, lexicon: DataFrame, small: float = 0.1) -> DataFrame:
    """(pred, frame, p): lexicon frames that training lacks get ``small`` where the predicate was seen, else 1; then shares."""
    seen = train.select("pred").distinct().withColumn("_seen", F.lit(True))
    both = train.join(lexicon.select("pred", "frame", F.lit(True).alias("_lex")), ["pred", "frame"], "full_outer").join(seen, "pred", "left")
    weight = F.coalesce(F.col("w"), F.when(F.col("_seen"), small).otherwise(1.0))
    return normalize_distribution(both.select("pred", "frame", weight.alias("w")))


def knn(similar: DataFrame, k: int = 21) -> DataFrame:
    """The first k neighbours (unit, nbr, sim, position) of each unit in file order."""
    order = Window.partitionBy("unit").orderBy("position", "nbr")
    return similar.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def normalize_neighbors(lines: DataFrame) -> DataFrame:
    """(unit, nbr, sim) from (unit, line, nbr, sim): means within a line, then over a unit's lines; heaviest first."""
    within = lines.groupBy("unit", "line", "nbr").agg(F.avg("sim").alias("sim"))
    return within.groupBy("unit", "nbr").agg(F.avg("sim").alias("sim")).orderBy("unit", F.col("sim").desc(), "nbr")


def adjective_adverb_counts(tokens: DataFrame) -> DataFrame:
    """(word, adj, adv): how often each lower-cased form has a J or RB tag."""
    counted = tokens.where(F.col("postag").startswith("J") | F.col("postag").startswith("RB"))
    return counted.groupBy(F.lower("form").alias("word")).agg(F.count_if(F.col("postag").startswith("J")).alias("adj"), F.count_if(F.col("postag").startswith("RB")).alias("adv"))


def route_pos(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Words with ``routes`` (array of a, adv): both if shares differ by less than 0.2; unseen -ly is an adverb, else both."""
    share = (F.col("adj") - F.col("adv")) / (F.col("adj") + F.col("adv"))
    both = F.array(F.lit("a"), F.lit("adv"))
    seen = F.when(F.abs(share) < 0.2, both).when(share > 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("adv")))
    unseen = F.when(F.col("word").endswith("ly"), F.array(F.lit("adv"))).otherwise(both)
    return words.join(counts, "word", "left").select("word", F.when(F.col("adj").isNull(), unseen).otherwise(seen).alias("routes"))


def index_strings(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """(value, idx): distinct strings numbered from 0 as they are first seen in the order of a column, else in their own
    order.

    Numbers come from a range partitioning and each partition's offset, not from one task over all strings.
    """
    rows = df.where(F.col(column).isNotNull())
    if order is None:
        return number(rows.select(F.col(column).alias("value")).distinct(), "value", 0)
    first = rows.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return number(first.select("value", F.struct("_first", "value").alias("_place")), "_place", 0).drop("_place")


def number(df: DataFrame, by: str, start: int) -> DataFrame:
    """``df`` with ``idx`` in the order of a column whose values are distinct; the parts keep their place in a written table."""
    from tessera.operators.scratch import written

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1 + start
    ranked = parts.withColumn("_within", within).join(F.broadcast(sizes.withColumn("_offset", offset).drop("_n")), "_part")
    return ranked.withColumn("idx", F.col("_within") + F.col("_offset")).drop("_part", "_within", "_offset")


