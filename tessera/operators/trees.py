"""Dependency trees as DataFrames of tokens (sid, id, head, ...), ids from 1, head 0 for a root.

Whatever walks a tree does so inside one row: a sentence's heads are gathered once into an array (one shuffle by
sentence) and higher-order functions follow it, so that depth costs no further exchange. Sentences are short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_heads(tokens: DataFrame) -> DataFrame:
    """(sid, heads): the heads of each sentence in token order; ids are taken to be 1 to n."""
    pairs = F.array_sort(F.collect_list(F.struct("id", "head")))
    return tokens.groupBy("sid").agg(F.transform(pairs, lambda x: x["head"].cast("int")).alias("heads"))


def links_up(heads: Column) -> Column:
    """Links from each token to the root, for all tokens at once: every round doubles how far each has looked, so that a
    sentence of n tokens takes log n rounds at any depth. Tokens that never reach the root get n or more."""
    jump = F.transform(heads, lambda h: F.when(h > 0, h).otherwise(0))
    start = F.struct(jump.alias("jump"), F.transform(jump, lambda h: F.when(h > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("links"))

    def further(acc: Column, _: Column) -> Column:
        at = lambda name, j: F.when(j > 0, F.get(acc[name], j - 1)).otherwise(0)
        return F.struct(
            F.transform(acc["jump"], lambda j: at("jump", j)).alias("jump"),
            F.transform(acc["links"], lambda n, i: n + at("links", F.get(acc["jump"], i))).alias("links"),
        )

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(heads) + 1)).cast("int") + 1)
    return F.aggregate(rounds, start, further, lambda acc: acc["links"])


def deepest(heads: Column) -> Column:
    """How many links a walk from any token can take; walks of circles are cut at the sentence's length."""
    return F.least(F.coalesce(F.array_max(links_up(heads)), F.lit(0)) + 1, F.size(heads)).cast("int")


def up(heads: Column, start: Column, deep: Column) -> Column:
    """Array of a token and its ancestors, nearest first, without the root's 0; ``deep`` bounds the walk (:func:`deepest`)."""
    step = lambda acc, _: F.when(
        F.element_at(acc, -1) > 0, F.concat(acc, F.array(F.get(heads, F.element_at(acc, -1) - 1)))
    ).otherwise(acc)
    chain = F.aggregate(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), F.array(start.cast("int")), step)
    return F.filter(chain, lambda x: x > 0)


def _chains(tokens: DataFrame) -> DataFrame:
    """(sid, id, chain): every token with itself and its ancestors."""
    rows = with_heads(tokens).withColumn("deep", deepest(F.col("heads"))).select("sid", "heads", "deep", F.posexplode("heads").alias("pos", "head"))
    return rows.select("sid", (F.col("pos") + 1).alias("id"), up(F.col("heads"), F.col("pos") + 1, F.col("deep")).alias("chain"))


def children(tokens: DataFrame) -> DataFrame:
    """(sid, id, children): each node, 0 for the root, with its children in order."""
    kids = tokens.groupBy("sid", F.col("head").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    return kids


def ancestors(tokens: DataFrame) -> DataFrame:
    """(sid, id, ancestor, hops): every token with each of its ancestors; hops count from 1."""
    return _chains(tokens).select("sid", "id", F.posexplode("chain").alias("hops", "ancestor")).where("hops > 0").select("sid", "id", "ancestor", "hops")


def descendants(tokens: DataFrame) -> DataFrame:
    """(sid, id, descendant, hops)."""
    return ancestors(tokens).select("sid", F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "hops")


def depth(tokens: DataFrame) -> DataFrame:
    """(sid, id, depth): links to the root; a token whose head is 0 has depth 1."""
    rows = with_heads(tokens).select("sid", F.posexplode(links_up(F.col("heads"))).alias("pos", "links"))
    return rows.select("sid", (F.col("pos") + 1).alias("id"), (F.col("links") + 1).cast("int").alias("depth"))


def extents(heads: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last descendant, itself included, of each token of sentences that lie one behind the other; ``begin`` is where
    a token's sentence begins. Leaves go first, each once its children are through; circles go round until nothing changes."""
    place = np.arange(len(heads))
    first, last = place - begin + 1, place - begin + 1
    parent = np.where(heads > 0, begin + heads - 1, -1)
    waiting = np.bincount(parent[parent >= 0], minlength=len(heads))
    ready = np.flatnonzero(waiting == 0)
    done = np.zeros(len(heads), dtype=bool)
    while len(ready):
        done[ready] = True
        ready = ready[parent[ready] >= 0]
        above = parent[ready]
        np.minimum.at(first, above, first[ready])
        np.maximum.at(last, above, last[ready])
        np.subtract.at(waiting, above, 1)
        above = np.unique(above)
        ready = above[waiting[above] == 0]
    round_ = np.flatnonzero(~done)
    while len(round_):
        above = parent[round_]
        was = first[above], last[above]
        np.minimum.at(first, above, first[round_])
        np.maximum.at(last, above, last[round_])
        if np.array_equal(was[0], first[above]) and np.array_equal(was[1], last[above]):
            break
    return first, last


#: Sentences have fewer tokens than this.
SPAN = 1 << 31


def _halves(ids: list[int], first: list[int], last: list[int], lone: list[bool]) -> list[int]:
    """Spans, each one number, that the rules add to a sentence with tokens ``ids`` that have descendants on both sides."""
    base = {a * SPAN + b for a, b in zip(first, last, strict=True)}
    base.update(i * SPAN + i for i in range(1, len(first) + 1))
    added = {}
    for i in ids:
        a, b = first[i - 1], last[i - 1]
        before, after = a * SPAN + i - 1, (i + 1) * SPAN + b
        right = not (a == i - 1 and lone[i - 2]) and (before in base or before in added)
        left = after in base or after in added
        if right:
            added[i * SPAN + b] = None
        if left:
            added[a * SPAN + i] = None
    return [s for s in added if s not in base]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extents of all tokens of each sentence, and the spans to be added where marks of lone words are given."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        heads = lists.flatten().to_numpy(zero_copy_only=False)
        begin = np.repeat(offsets[:-1], np.diff(offsets))
        first, last = extents(heads, begin)
        columns = [batch.column(0), *(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c, pa.int32())) for c in (first, last))]
        if batch.num_columns == 2:
            yield pa.RecordBatch.from_arrays(columns, ["sid", "first", "last"])
            continue
        place = np.arange(len(heads)) - begin + 1
        both = np.flatnonzero((first < place) & (last > place))
        sentence = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[both]
        cut = np.searchsorted(sentence, np.arange(batch.num_rows + 1)).tolist()
        ids, first, last, lone = place[both].tolist(), first.tolist(), last.tolist(), batch.column(2).flatten().to_pylist()
        new, ends, at = [], [0], offsets.tolist()
        for k in range(batch.num_rows):
            if cut[k] < cut[k + 1]:
                a, b = at[k], at[k + 1]
                new += _halves(ids[cut[k] : cut[k + 1]], first[a:b], last[a:b], lone[a:b])
            ends.append(len(new))
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(new, pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, ["sid", "first", "last", "new"])


def sentence_spans(tokens: DataFrame, halves: bool = True) -> DataFrame:
    """(sid, first, last[, new]): arrays of each sentence's extents by token and of the half constituents to be added, each
    one number. One shuffle by sentence; the walk takes time in proportion to the tokens, at any depth."""
    head = F.coalesce(F.col("head").cast("int"), F.lit(0)).alias("head")
    lone = F.coalesce(F.substring("postag", 1, 2).isin("DT", "JJ"), F.lit(False)).alias("lone") if halves else F.lit(None).cast("boolean").alias("lone")
    by = tokens.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("id", head, lone))).alias("t"))
    fields = [F.transform("t", lambda x: x["head"]).alias("heads"), *([F.transform("t", lambda x: x["lone"]).alias("lone")] if halves else [])]
    return array_spans(by.select("sid", *fields))


def lone(t: Column) -> Column:
    """Marks of a sentence's tokens (postag): words that no half constituent leaves alone."""
    return F.transform(t, lambda x: F.coalesce(F.substring(x["postag"], 1, 2).isin("DT", "JJ"), F.lit(False)))


def array_spans(by: DataFrame) -> DataFrame:
    """:func:`sentence_spans` of sentences that are rows already: (sid, heads[, lone]), arrays in order, no head null."""
    schema = T.StructType([by.schema["sid"], T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("last", T.ArrayType(T.IntegerType()))])
    return by.mapInArrow(_spans, schema.add("new", T.ArrayType(T.LongType())) if len(by.columns) == 3 else schema)


def constituents(tokens: DataFrame) -> DataFrame:
    """(sid, id, first, last): each token's leftmost and rightmost descendant, itself included."""
    kind = tokens.schema["id"].dataType
    rows = sentence_spans(tokens, halves=False).select("sid", F.posexplode(F.arrays_zip("first", "last")).alias("pos", "s"))
    return rows.select("sid", (F.col("pos") + 1).cast(kind).alias("id"), F.col("s.first").cast(kind).alias("first"), F.col("s.last").cast(kind).alias("last"))


def span_ends(s: Column) -> tuple[Column, Column]:
    """First and last token of a span that is one number."""
    return F.floor(s / SPAN).cast("int"), F.pmod(s, F.lit(SPAN)).cast("int")


def half_constituents(tokens: DataFrame) -> DataFrame:
    """(sid, first, last) of the spans to be added to a sentence's constituents.

    For a token i with descendants on both sides: [i, last] if [first, i - 1] is a span, unless that is one DT or JJ;
    and [first, i] if [i + 1, last] is a span. Rules run in token order and see spans added before.
    """
    found = sentence_spans(tokens).select("sid", F.explode("new").alias("s"))
    first, last = span_ends(F.col("s"))
    return found.select("sid", first.alias("first"), last.alias("last"))


def heuristic_head(tokens: DataFrame, groups: DataFrame, last_adjective: bool = False) -> DataFrame:
    """(sid, key, head_id) for groups (sid, key, idxs: array of ids): the word that stands for several.

    One token is its own head. Of those whose parent is outside: the first if a verb; the last if the first is an
    adjective (with ``last_adjective``, if the last is); the first if a noun and ``of`` is among the words; else the last.
    """
    parts = groups.select("sid", "key", F.size("idxs").alias("n"), F.col("idxs"), F.explode("idxs").alias("id"))
    words = parts.join(tokens.select("sid", "id", "head", "form", "postag"), ["sid", "id"])
    item = F.struct("id", "postag")
    by = words.groupBy("sid", "key").agg(
        F.array_sort(F.collect_list(F.when(~F.array_contains("idxs", F.col("head")), item))).alias("out"),
        F.bool_or(F.lower("form") == "of").alias("of"),
        F.min("id").alias("only"),
        F.max("n").alias("n"),
    )
    first, last = F.get("out", F.lit(0)), F.element_at("out", -1)
    adjective = (last if last_adjective else first)["postag"].startswith("J")
    choice = (
        F.when(F.col("n") == 1, F.col("only"))
        .when(first["postag"].startswith("V"), first["id"])
        .when(adjective, last["id"])
        .when(first["postag"].startswith("N") & F.col("of"), first["id"])
        .otherwise(last["id"])
    )
    return by.select("sid", "key", choice.alias("head_id"))


def array_head(w: Column, idxs: Column) -> Column:
    """:func:`heuristic_head` of a group whose tokens ``w`` (id, head, form, postag) stand in one row, in order of id."""
    out = F.filter(w, lambda x: ~F.array_contains(idxs, x["head"]))
    first, last = F.get(out, F.lit(0)), F.try_element_at(out, F.lit(-1))
    of = F.exists(w, lambda x: F.lower(x["form"]) == "of")
    return (
        F.when(F.size(w) == 1, F.get(w, F.lit(0))["id"])
        .when(first["postag"].startswith("V"), first["id"])
        .when(first["postag"].startswith("J"), last["id"])
        .when(first["postag"].startswith("N") & of, first["id"])
        .otherwise(last["id"])
    )


def path(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, a, b, lca, path) for pairs of ids: lowest common ancestor (0: none but the root) and the walk.

    The walk starts with ``=`` and a's label; ``^`` and a label for each step up, ``!`` and a label for each step down.
    """
    labels = F.transform(F.array_sort(F.collect_list(F.struct("id", "head", "deprel"))), lambda x: x["deprel"])
    heads = F.transform(F.array_sort(F.collect_list(F.struct("id", "head", "deprel"))), lambda x: x["head"].cast("int"))
    by = tokens.groupBy("sid").agg(heads.alias("heads"), labels.alias("labels"))
    by = by.withColumn("deep", deepest(F.col("heads")))
    both = pairs.join(by, "sid").withColumns({"_a": up(F.col("heads"), F.col("a"), F.col("deep")), "_b": up(F.col("heads"), F.col("b"), F.col("deep"))})
    common = F.array_intersect("_a", "_b")
    both = both.withColumn("lca", F.coalesce(F.get(common, F.lit(0)), F.lit(0)))
    label = lambda x: F.coalesce(F.get("labels", x - 1), F.lit("ROOT"))
    rise = F.filter("_a", lambda x: ~F.array_contains("_b", x) & (x != F.col("a")))
    fall = F.reverse(F.filter("_b", lambda x: ~F.array_contains("_a", x)))
    top = F.when(F.col("lca") == F.col("a"), F.lit("")).otherwise(F.concat(F.lit("^"), label(F.col("lca"))))
    walk = F.concat(
        F.lit("="), label(F.col("a")), F.array_join(F.transform(rise, lambda x: F.concat(F.lit("^"), label(x))), ""), top,
        F.array_join(F.transform(fall, lambda x: F.concat(F.lit("!"), label(x))), ""),
    )
    return both.select("sid", "a", "b", "lca", walk.alias("path"))


def sides(tokens: DataFrame) -> DataFrame:
    """(sid, id, left_children, right_children, left_descendants, right_descendants): sizes by side."""
    kids = tokens.where("head > 0").groupBy("sid", F.col("head").alias("id")).agg(
        F.count_if(F.col("id") < F.col("head")).alias("left_children"), F.count_if(F.col("id") > F.col("head")).alias("right_children")
    )
    deep = descendants(tokens).groupBy("sid", "id").agg(
        F.count_if(F.col("descendant") < F.col("id")).alias("left_descendants"), F.count_if(F.col("descendant") > F.col("id")).alias("right_descendants")
    )
    return tokens.select("sid", "id").join(kids, ["sid", "id"], "left").join(deep, ["sid", "id"], "left").na.fill(0)


def voice(tokens: DataFrame) -> DataFrame:
    """(sid, id, voice) of verbs: ACT or PAS.

    ``been`` and anything but VBN is active. A participle climbs to the first ancestor with a verdict: a noun or a form
    of be makes it passive, a form of have active, a finite verb or modal passive; at the root it is passive.
    """
    be, have = ["be", "am", "is", "are", "was", "were", "been", "being"], ["have", "has", "had", "having"]
    pieces = F.array_sort(F.collect_list(F.struct("id", "head", "postag", F.lower("form").alias("form"))))
    by = tokens.groupBy("sid").agg(pieces.alias("t"))
    by = by.withColumn("heads", F.transform("t", lambda x: x["head"].cast("int"))).withColumn("deep", deepest(F.col("heads")))
    by = by.select("sid", "t", "heads", "deep", F.explode("t").alias("x")).where(F.col("x.postag").startswith("V"))
    walk = up(F.col("heads"), F.col("x.id"), F.col("deep"))
    chain = F.slice(walk, 2, F.size(walk))
    verdict = lambda y: (
        F.when(y["postag"].startswith("NN") | y["form"].isin(be), "PAS").when(y["form"].isin(have), "ACT").when(y["postag"].isin("VBZ", "VBD", "VBP", "MD"), "PAS")
    )
    found = F.filter(F.transform(chain, lambda i: verdict(F.get(F.col("t"), i - 1))), lambda v: v.isNotNull())
    active = (F.col("x.form") == "been") | (F.col("x.postag") != "VBN")
    return by.select("sid", F.col("x.id").alias("id"), F.when(active, "ACT").otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit("PAS"))).alias("voice"))


def match_constituent(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(sid, first, last, parse_idx): the first of several parses (tokens with parse_idx) in which a span is a constituent:
    exactly one of its tokens has its parent outside, and none has a child beyond it."""
    inside = spans.join(tokens.select("sid", "parse_idx", "id", "head"), "sid")
    within = lambda c: (F.col(c) >= F.col("first")) & (F.col(c) <= F.col("last"))
    by = inside.groupBy("sid", "first", "last", "parse_idx").agg(
        F.count_if(within("id") & ~within("head")).alias("tops"), F.count_if(~within("id") & within("head")).alias("strays")
    )
    return by.where("tops = 1 and strays = 0").groupBy("sid", "first", "last").agg(F.min("parse_idx").alias("parse_idx"))


def ancestry_chains(tokens: DataFrame, k: int) -> DataFrame:
    """(sid, id, chain): each token with up to k nearest ancestors, nearest first."""
    return _chains(tokens).select("sid", "id", F.slice("chain", 2, k).alias("chain"))


def topological_rank(tokens: DataFrame) -> DataFrame:
    """(sid, id, rank): a parent's rank is below its children's; by depth, then id."""
    order = Window.partitionBy("sid").orderBy("depth", "id")
    return depth(tokens).withColumn("rank", F.row_number().over(order)).select("sid", "id", "rank")
