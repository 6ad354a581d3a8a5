"""The error-neighbourhood graph (G1 to G7, C4 to C6): weighted edges, bounded expansion from anchors, ranking, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.plans.scale import range_join, topk_per_group, written
from replog.sources.logs import refresh_facts

FILE, LINE = ["file_id"], "line_number"


def _by_words(rows: DataFrame, line: str) -> DataFrame:
    """Rows (file_id, line, word) as one for each line, with its set of words as text."""
    return rows.groupBy("file_id", line).agg(F.concat_ws(" ", F.array_sort(F.collect_set("word"))).alias("words"))


def batch_classes(errors: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Errors whose text has the last part of the name of a batch's table, in classes: errors (file_id, error_line, words) and batches (file_id, batch_line, words) by what they have of
    words that both sides know, and which sets meet (file_id, error_words, batch_words, n: the pairs of lines that they stand for). Each pair of lines is in one pair of sets."""
    names = batches.select("file_id", F.col(LINE).alias("batch_line"), F.explode("tables").alias("t")).select("file_id", "batch_line", F.lower(F.regexp_extract("t", r"([^.]+)$", 1)).alias("word")).filter("word <> ''")
    words = errors.select("file_id", F.col(LINE).alias("error_line"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\w]+"))).alias("word"))
    words = written(words.join(names.select("file_id", "word").distinct(), ["file_id", "word"], "left_semi"))
    names = names.join(words.select("file_id", "word").distinct(), ["file_id", "word"], "left_semi")
    own, other = written(_by_words(words, "error_line")), written(_by_words(names, "batch_line"))
    sets = lambda df, side: df.groupBy("file_id", F.col("words").alias(f"{side}_words")).agg(F.count("*").alias(f"_{side}")).withColumn("word", F.explode(F.split(f"{side}_words", " ")))
    met = sets(own, "error").join(sets(other, "batch"), ["file_id", "word"]).groupBy("file_id", "error_words", "batch_words").agg((F.max("_error") * F.max("_batch")).alias("n"))
    return own, other, met


def errors_in_batches(errors: DataFrame, batches: DataFrame) -> DataFrame:
    """Errors whose text has the last part of the name of a batch's table: texts and names meet by their words."""
    own, other, met = batch_classes(errors, batches)
    pairs = own.withColumnRenamed("words", "error_words").join(met, ["file_id", "error_words"]).join(other.withColumnRenamed("words", "batch_words"), ["file_id", "batch_words"])
    return pairs.select("file_id", "error_line", "batch_line")


def cooccurring_errors(errors: DataFrame, distance: int = 50) -> DataFrame:
    """Pairs of errors at most distance lines apart with the same component, else code, else thread; nearer ones weigh more."""
    own = errors.select("file_id", F.col(LINE).alias("a"), "component", "error_code", "thread_id")
    other = errors.select("file_id", (F.col(LINE) - distance).alias("_s"), (F.col(LINE) - 1).alias("_e"), F.col(LINE).alias("b"), F.col("component").alias("c2"), F.col("error_code").alias("e2"), F.col("thread_id").alias("t2"))
    pairs = range_join(own, other, FILE, "a", "_s", "_e", distance)
    why = F.when(F.col("component") == F.col("c2"), "component").when(F.col("error_code") == F.col("e2"), "code").when(F.col("thread_id") == F.col("t2"), "thread")
    return pairs.select("file_id", "a", "b", why.alias("why"), F.greatest(F.lit(0.2), 1 - (F.col("b") - F.col("a")) / distance).alias("weight")).filter("why is not null")


def _node(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, weight: Column, how: str) -> DataFrame:
    return df.select("file_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), weight.alias("weight"), F.lit(how).alias("provenance"))


def _own_edges(errors: DataFrame) -> DataFrame:
    """Edges of errors to components, threads, codes and errors near."""
    out = None
    for c, kind, name, weight in (("component", "component", "in_component", 1.0), ("thread_id", "thread", "on_thread", 0.5), ("error_code", "code", "has_code", 1.5)):
        part = _edge(errors.filter(F.col(c).isNotNull()), _node("error", LINE), _node(kind, c), name, F.lit(weight), "EXTRACTED")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(_edge(cooccurring_errors(errors), _node("error", "a"), _node("error", "b"), "co_occurs", F.col("weight"), "INFERRED"))


def error_edges(errors: DataFrame, batches: DataFrame) -> DataFrame:
    """Edges (file_id, src, dst, edge_type, weight, provenance) between errors, components, threads, codes and batches."""
    return _own_edges(errors).unionByName(_edge(errors_in_batches(errors, batches), _node("error", "error_line"), _node("batch", "batch_line"), "same_batch", F.lit(0.8), "EXTRACTED"))


#: Kinds of rows of compact edges that say which set of words a line has.
MEMBERS = {"error_words": "error", "batch_words": "batch"}


def compact_edges(errors: DataFrame, batches: DataFrame) -> DataFrame:
    """error_edges with n, the edges that a row stands for. Errors and batches of the same words are as many edges as there are pairs of lines; here they are one row for each pair of
    sets of words (n: the pairs of lines), and one for each line's membership of its set (n is 0). No edge is lost: expand_edges makes all of them from these rows."""
    own, other, met = batch_classes(errors, batches)
    links = met.select("file_id", _node("words", "error_words").alias("src"), _node("words", "batch_words").alias("dst"), F.lit("same_batch").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit("EXTRACTED").alias("provenance"), "n")
    out = _own_edges(errors).withColumn("n", F.lit(1).cast("long")).unionByName(links)
    for df, (kind, side) in zip((own, other), MEMBERS.items()):
        out = out.unionByName(_edge(df, _node(side, f"{side}_line"), _node("words", "words"), kind, F.lit(0.8), "EXTRACTED").withColumn("n", F.lit(0).cast("long")))
    return out


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges and their weight by file, type and provenance, of compact edges."""
    return edges.filter("n > 0").groupBy("file_id", "edge_type", "provenance").agg(F.sum("n").alias("n"), F.sum(F.col("weight") * F.col("n")).alias("weight"))


def expand_edges(edges: DataFrame, most: int | None = None) -> DataFrame:
    """All edges of compact edges. With most, of the pairs of lines of the same words only those to the first lines by name, most for each line: among edges of one weight no others can
    be the most heaviest of a line, with ties by name. They come both ways then, each with the lines that it is among the first of as src."""
    plain = edges.filter(~F.col("edge_type").isin("same_batch", *MEMBERS)).drop("n")
    met = edges.filter("edge_type = 'same_batch'").select("file_id", F.col("src").alias("error_words"), F.col("dst").alias("batch_words"), "weight", "provenance")
    member = {k: edges.filter(F.col("edge_type") == k).select("file_id", F.col("dst").alias(k), F.col("src").alias(f"_{k}")) for k in MEMBERS}
    shape = lambda df, src, dst: df.select("file_id", F.col(f"_{src}").alias("src"), F.col(f"_{dst}").alias("dst"), F.lit("same_batch").alias("edge_type"), "weight", "provenance")
    if most is None:
        return plain.unionByName(shape(member["error_words"].join(met, ["file_id", "error_words"]).join(member["batch_words"], ["file_id", "batch_words"]), "error_words", "batch_words"))
    out = plain.unionByName(plain.select("file_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight", "provenance"))
    for src, dst in (("error_words", "batch_words"), ("batch_words", "error_words")):
        first = topk_per_group(member[dst], ["file_id", dst], [f"_{dst}"], most)
        lists = topk_per_group(first.join(met, ["file_id", dst]), ["file_id", src], [F.desc("weight"), f"_{dst}"], most).drop(dst)
        out = out.unionByName(shape(member[src].join(lists, ["file_id", src]), src, dst))
    return out


def _adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges both ways (as they are, if directed), one for each pair of nodes: the greatest weight, and that edge's provenance (EXTRACTED first)."""
    own = edges if "provenance" in edges.columns else edges.withColumn("provenance", F.lit("EXTRACTED"))
    own = own.select("file_id", "src", "dst", "weight", "provenance")
    both = own if directed else own.unionByName(own.select("file_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "provenance"))
    return both.groupBy("file_id", "src", "dst").agg(F.max("weight").alias("weight"), F.max_by("provenance", F.struct("weight", _extracted())).alias("provenance"))


def _extracted() -> Column:
    return F.coalesce(F.col("provenance") == "EXTRACTED", F.lit(False))


def neighbors(edges: DataFrame, anchors: DataFrame, hops: int = 2, k: int = 30) -> DataFrame:
    """The k best nodes around each anchor (file_id, anchor): a path's score starts with its first edge's weight, and each further hop halves it and takes the edge's weight; a node has its best, with the provenance of that path's last edge. All nodes can be anchors.

    While half of the greatest weight is below 1, a further hop only lowers a score. Then (a) of a node's edges the k + 1 heaviest are all that can matter, for each of the
    others has k better ones with the same begin; so a hub has k + 1 rows, however many edges it has; and (b) only nodes among an anchor's k best so far can lead to one that
    belongs there. Each hop is so at most anchors x k x (k + 1) rows, and is written before the next. With heavier edges, or weights below 0, nothing is left out.

    Before a further hop (c) a bar is known for each anchor: the score of its k-th best so far, or the least that the k + 1 heaviest edges of one of its nodes lead to. What stays
    below it has k better ones, so nodes whose heaviest edge does, and edges that do, are left out before rows are joined and shuffled.

    Edges may be compact ones: of those a line gets the k + 1 first of its set, not all. Edges without the column provenance count as EXTRACTED. Equal scores: fewer hops first, then
    extracted edges; of nodes, in the order of their names."""
    least, most = edges.agg(F.min("weight"), F.max("weight")).first()
    falls = least is None or (least >= 0 and most < 2.0)
    compact = "n" in edges.columns
    both = _adjacency(expand_edges(edges, k + 1 if falls else None), directed=falls) if compact else _adjacency(edges)
    near = written(topk_per_group(both, ["file_id", "src"], [F.desc("weight"), "dst"], k + 1) if falls else both)
    heads = near.groupBy(F.col("file_id").alias("_file"), F.col("src").alias("_src")).agg(F.max("weight").alias("_most"), F.when(F.count("*") > k, F.min("weight")).alias("_least"))
    near = near.select(F.col("file_id").alias("_file"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("weight").alias("_weight"), F.col("provenance"))
    order = F.struct("score", -F.col("hop"), _extracted())
    one = lambda df: df.groupBy("file_id", "anchor", "node").agg(F.max("score").alias("score"), F.max_by("hop", order).alias("hop"), F.max_by("provenance", order).alias("provenance"))
    front, best = anchors.select("file_id", "anchor", F.col("anchor").alias("node"), F.lit(1.0).alias("score"), F.lit(0.0).alias("_bar")).distinct(), None
    last = min(hops, 3)
    for hop in range(1, last + 1):
        decay = 1.0 if hop == 1 else 0.5
        step = front.join(near, (F.col("file_id") == F.col("_file")) & (F.col("node") == F.col("_src"))).filter("_dst <> anchor")
        reached = step.select("file_id", "anchor", F.col("_dst").alias("node"), (F.col("score") * decay * F.col("_weight")).alias("score"), F.lit(hop).alias("hop"), "provenance", "_bar")
        reached = (reached.filter(F.col("score") >= F.col("_bar")) if falls else reached).drop("_bar")
        own = one(reached)
        best = own if best is None else one(best.unionByName(own))
        if hop == last:
            break
        if falls:
            best = topk_per_group(best, ["file_id", "anchor"], [F.desc("score"), "node"], k)
        best = written(best)
        front = _beyond(best, heads, hop, k) if falls else written(own).withColumn("_bar", F.lit(0.0))
        front = front.select("file_id", "anchor", "node", "score", "_bar")
    return topk_per_group(best, ["file_id", "anchor"], [F.desc("score"), "node"], k, "rank")


def _beyond(best: DataFrame, heads: DataFrame, hop: int, k: int) -> DataFrame:
    """The nodes of the last hop that can lead to one of an anchor's k best, with the bar for that."""
    w = W.partitionBy("file_id", "anchor")
    further = F.col("score") * 0.5
    known = best.join(heads, (F.col("file_id") == F.col("_file")) & (F.col("node") == F.col("_src")))
    sure = F.max(F.when(F.col("hop") == hop, further * F.col("_least"))).over(w)
    kth = F.when(F.count("*").over(w) >= k, F.min("score").over(w))
    barred = known.withColumn("_bar", F.coalesce(F.greatest(sure, kth), F.lit(0.0)))
    return barred.filter((F.col("hop") == hop) & (further * F.col("_most") >= F.col("_bar")))


def rank_neighbors(found: DataFrame, files: DataFrame) -> DataFrame:
    """Scores weighed by hops, by the distance from the anchor as a part of the file's own lines (file_id, line_count), and by 1.2 where the path's last edge was extracted."""
    line = lambda c: F.nullif(F.regexp_extract(c, r"^error:(\d+)$", 1), F.lit("")).cast("long")
    total = F.when(F.col("line_count") > 0, F.col("line_count"))
    part = F.abs(line("node") - line("anchor")) / total
    # greatest() passes over nulls, so a node or anchor without a line would have the least
    near = F.when(part.isNull(), 1.0).otherwise(F.greatest(F.lit(0.2), 1 - part))
    sure = F.when(F.col("provenance") == "EXTRACTED", 1.2).otherwise(1.0)
    joined = found.join(files.select("file_id", "line_count"), "file_id", "left")
    return joined.withColumn("final", F.col("score") / (1 + 0.5 * F.col("hop")) * sure * near).drop("line_count")


def related_context(edges: DataFrame, anchors: DataFrame, errors: DataFrame, hops: int = 2, k: int = 30) -> DataFrame:
    """Neighbours with their kind and label, the error's text where they are errors, and whether an anchor has too few."""
    found = neighbors(edges, anchors, hops, k)
    named = found.withColumns({"kind": F.regexp_extract("node", r"^(\w+):", 1), "label": F.regexp_extract("node", r"^\w+:(.*)$", 1)})
    texts = errors.select("file_id", F.concat(F.lit("error:"), F.col(LINE).cast("string")).alias("node"), "text", "error_code")
    return named.join(texts, ["file_id", "node"], "left").withColumn("weak", F.count("*").over(W.partitionBy("file_id", "anchor")) < 2)


def pack_to_budget(facts: DataFrame, budget: int, keys: list[str], order: list, text: str = "text") -> DataFrame:
    """Facts in order until the next would pass the budget; a fact has a token for four characters, one at least."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cost = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    summed = facts.withColumn("tokens", cost).withColumn("used", F.sum("tokens").over(w))
    return summed.filter(F.col("used") <= budget)


def anchor_budget(anchors: DataFrame, total: int = 600, most: int = 3) -> DataFrame:
    """The first anchors of each file that are not weak, with an equal part of the budget, 80 at least."""
    own = topk_per_group(anchors.filter("not weak"), FILE, ["anchor"], most)
    return own.withColumn("budget", F.greatest(F.lit(80), F.floor(F.lit(total) / F.count("*").over(W.partitionBy("file_id")))))


def findings_near(findings: DataFrame, errors: DataFrame, distance: int = 50) -> DataFrame:
    """Saved findings less than distance lines from an error."""
    spans = errors.select("file_id", F.col(LINE).alias("error_line"), (F.col(LINE) - distance + 1).alias("_s"), (F.col(LINE) + distance - 1).alias("_e"))
    return range_join(findings, spans, FILE, LINE, "_s", "_e", 2 * distance)


def write_graph(edges: DataFrame, path: str, fingerprint: str) -> None:
    """Keeps edges by file with the fingerprint that they were made from."""
    edges.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)


def cached_graph(lines: DataFrame, versions: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges of all files of versions (file_id, fingerprint): those kept below path under the same fingerprint are read, the others made from their lines and kept."""
    return refresh_facts(lines, versions, path, make)
