"""Stand-ins over the driver's tables for queries and tests: sentences, tokens with tags and trees, small lexicons.

The tables hold prose without syntax. Tags follow suffixes, the head of token i is i & (i - 1) (a projective forest
whose subtrees are contiguous), relation names follow i modulo 5. Each has its SQL twin for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens as tokens_of
from tessera.functions.text import tokenize_sql
from tessera.session import spread

TAGS = """CASE WHEN regexp_like(form, '^[0-9]') THEN 'CD' WHEN lower(form) IN ('the', 'a', 'an') THEN 'DT'
 WHEN lower(form) IN ('of', 'in', 'on', 'at', 'for', 'by', 'with') THEN 'IN' WHEN lower(form) = 'to' THEN 'TO'
 WHEN lower(form) IN ('and', 'or') THEN 'CC' WHEN form LIKE '%ing' THEN 'VBG' WHEN form LIKE '%ed' THEN 'VBD'
 WHEN form LIKE '%en' THEN 'VBN' WHEN form LIKE '%ly' THEN 'RB' WHEN form LIKE '%ble' THEN 'JJ' WHEN form LIKE '%s' THEN 'NNS'
 WHEN NOT regexp_like(form, '[A-Za-z]') THEN '.' ELSE 'NN' END"""
LABELS = "CASE id % 5 WHEN 0 THEN 'VMOD' WHEN 1 THEN 'SUB' WHEN 2 THEN 'OBJ' WHEN 3 THEN 'NMOD' ELSE 'P' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, text) for each line that is not blank."""
    out = spread(docs.select(key, "text")).select(key, F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return out.where(F.trim("text") != "")


LINES_SQL = """SELECT doc_id, (i - 1)::INTEGER AS line, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d,
 unnest(range(1, len(parts) + 1)) AS r(i) WHERE trim(parts[i]) <> ''"""


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, line, words): tokens of every line of every document."""
    return lines(docs).select("doc_id", "line", tokens_of(F.col("text")).alias("words"))


SENTENCES_SQL = f"SELECT doc_id, line, list_filter(string_split({tokenize_sql('text')}, ' '), lambda t: t <> '') AS words FROM ({LINES_SQL}) l"


def item_tokens(items: DataFrame) -> DataFrame:
    """Tokens of benchmark items: (sid, id, form, lemma, postag, head, deprel)."""
    words = items.select(F.col("item_id").alias("sid"), F.posexplode(F.split(F.trim("text"), r"[ \n]+")).alias("pos", "form"))
    return tagged(words.select("sid", (F.col("pos") + 1).alias("id"), "form"))


ITEM_TOKENS_SQL = f"""SELECT sid, id, form, lower(form) AS lemma, {TAGS.replace('regexp_like', 'regexp_matches')} AS postag, id & (id - 1) AS head, {LABELS} AS deprel FROM (
 SELECT item_id AS sid, i::INTEGER AS id, parts[i] AS form FROM (SELECT item_id, string_split_regex(trim(text), '[ \\n]+') AS parts FROM benchmark) b,
 unnest(range(1, len(parts) + 1)) AS r(i)) t"""


def tagged(words: DataFrame) -> DataFrame:
    """Tokens (sid, id, form) with lemma, tag, head and relation."""
    columns = {"lemma": F.lower("form"), "postag": F.expr(TAGS), "head": F.col("id").bitwiseAND(F.col("id") - 1), "deprel": F.expr(LABELS)}
    return words.withColumns(columns)


def rounded(c: Column | str, places: int = 6) -> Column:
    """Rounded so that summation order does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, places)
