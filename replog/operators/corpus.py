"""Knowledge-corpus jobs and vectors (K1 to K18, C7 to C13): pages, chunks, release notes, matches, reports."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.operators.parse import found
from replog.operators.terms import with_longest
from replog.plans.scale import forward_fill, topk_per_group, written

#: Phrases of a page's frame.
BOILERPLATE = (r"Was this article helpful\?\s*(Yes|No)?\s*(Yes|No)?", r"Labels:\s*[\w\s,]+(?=\s{2}|$)", r"Tags:\s*[\w\s,]+(?=\s{2}|$)", "Share this article", "Print this article", "Email this article", "Mark as New", "Bookmark", "Subscribe to RSS Feed", "Subscribe", "Mute", "Permalink", "Print", "Report Inappropriate Content")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


class Text(HTMLParser):
    """The text of a page's main part (of its body, if none is marked) and its title."""

    SKIP, MAIN = {"script", "style", "nav", "header", "footer", "aside", "noscript"}, {"main", "article"}

    def __init__(self) -> None:
        super().__init__()
        self.skip, self.main, self.in_title, self.title, self.body, self.inner = 0, 0, False, "", [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in self.SKIP
        self.main += tag in self.MAIN
        self.in_title = tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in self.SKIP and self.skip > 0
        self.main -= tag in self.MAIN and self.main > 0
        self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            (self.inner if self.main else self.body).append(data)


def page_text(html: str) -> tuple[str, str]:
    p = Text()
    p.feed(html)
    return " ".join(p.inner or p.body), p.title.strip()


#: Pages whose texts are held at once.
PAGES = 64


def clean_articles(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages as articles: main text without frame phrases, title without the site's name, id from the address, digest. Short ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some pages at a time, so that a batch of many or long pages is never all there as Python's texts
        for b in (b.slice(at, PAGES) for b in batches for at in range(0, b.num_rows, PAGES)):
            both = [page_text(h.as_py() or "") for h in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([t for t, _ in both], pa.string()), pa.array([t for _, t in both], pa.string())], ["url", "raw", "raw_title"])

    out = pages.select("url", "html").mapInArrow(run, "url string, raw string, raw_title string")
    text = F.regexp_replace("raw", r"\s+", " ")
    for phrase in BOILERPLATE:
        text = F.regexp_replace(text, f"(?i){phrase}", " ")
    out = out.withColumn("content", F.trim(F.regexp_replace(text, r"\s+", " "))).filter(F.length("content") >= least)
    return out.select("url", F.coalesce(found("url", r"/(\d+)/?$"), found("url", r"([^/]+)/?$")).alias("article_id"), F.trim(F.regexp_replace("raw_title", r"\s+[-|]\s+[^-|]*$", "")).alias("title"), "content", F.length("content").alias("content_length"), F.substring(F.md5(F.col("content").cast("binary")), 1, 12).alias("content_hash"))


def discover_urls(sitemaps: DataFrame, pattern: str = ".*", words: Sequence[str] = ()) -> DataFrame:
    """Distinct addresses of sitemaps (xml), with their last change, that match a pattern and any of the words."""
    entry = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1)))
    out = sitemaps.select(entry.alias("e")).select(F.trim(F.regexp_extract("e", r"(?s)<loc>\s*(.*?)\s*</loc>", 1)).alias("url"), found("e", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>").alias("lastmod")).filter(F.col("url").rlike(pattern))
    if words:
        out = out.filter(F.lower("url").rlike("|".join(re.escape(w.lower()) for w in words)))
    return out.groupBy("url").agg(F.max("lastmod").alias("lastmod"))


def chunk_text(text: str, size: int = 2000, overlap: int = 200, least: int = 100) -> list[str]:
    """Sentences packed to about size characters; each chunk begins with the end of the one before. A sentence is never cut.

    Sums of the sentences' lengths, each with the space after it, say how far a chunk that begins at one of them reaches."""
    sentences = re.split(r"(?<=[.!?])\s+", text)
    reach = [0, *accumulate(len(s) + 1 for s in sentences)]
    chunks, begin, tail = [], 0, ""
    while begin < len(sentences):
        # the first sentence is always taken, later ones while they fit beside the tail
        end = max(begin + 1, bisect_right(reach, size - len(tail) + reach[begin] + 1) - 1)
        chunk = " ".join(([tail] if tail else []) + sentences[begin:end])
        if len(chunk) > least:
            chunks.append(chunk)
        begin, tail = end, chunk[max(0, len(chunk) - overlap) :]
    return chunks


def chunk_documents(docs: DataFrame, key: str, text: str, source: str = "doc", size: int = 2000, overlap: int = 200) -> DataFrame:
    """key, chunk_index, chunk_id and chunk of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([chunk_text(t or "", size, overlap) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], [key, "chunks"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunks array<string>").select(key, F.posexplode("chunks").alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_id", F.concat(F.lit(f"{source}_"), F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), F.lit("_"), F.col("chunk_index").cast("string")))


def parse_fix_entries(notes: DataFrame, col: str = "text") -> DataFrame:
    """Entries that begin with an issue number: case, type, component and description; the first of each number."""
    block = F.explode(F.split(col, r"(?=Jira issue:\s*RECOB-\d+)"))
    e = notes.select("version", block.alias("b")).filter(F.col("b").rlike(r"^Jira issue:\s*RECOB-\d+"))
    out = e.select("version", found("b", r"(RECOB-\d+)").alias("fix_id"), found("b", r"(?i)Salesforce case:\s*([^\n]+)").alias("case"), found("b", r"(?i)Type:\s*([^\n]+)").alias("type"), found("b", r"(?i)Component/Process:\s*([^\n]+)").alias("component"), F.substring(found("b", r"(?is)Description:\s*(.+?)\s*$"), 1, 300).alias("description"))
    return topk_per_group(out, ["fix_id"], ["version"], 1)


#: Titles that open a section on the end of support and those that close it, and words that keep a short line of plain text from being a title.
EOL_OPENS, EOL_OTHER = r"no longer supported|has been discontinued|\bend of support\b", r"end of life.*support features|support features.*end of life|end of support features"
EOL_CLOSES, EOL_PLAIN_CLOSES = r"^(newly supported|resolved issues|what'?s new|known issues|downloads)\b", r"^(newly supported|resolved issues|known issues|what'?s new|downloads|migration and upgrade)\b"
EOL_KEEPS = "discontinued|deprecated|support for|minimum|xml configuration"


def parse_eol_entries(notes: DataFrame, col: str = "text", most: int = 50) -> DataFrame:
    """Lines of the sections on the end of support, the first `most` of each; version, section (its number in the text), at (line) and entry.

    A text with Markdown headings: a section ends at a heading of a higher level than its own or at one of another topic. A text without: it begins at a line that says just
    `end of support`, ends at another topic's, and short titles in between are passed over."""
    rows = notes.select("version", F.posexplode(F.split(col, "\n")).alias("at", "raw"), F.col(col).rlike(r"(?m)^\s*#{1,6}\s+\S").alias("marked"))
    own = rows.withColumns({"line": F.trim("raw"), "body": F.lower(F.trim(F.regexp_replace(F.trim("raw"), r"^#{1,6}\s+", "")))})
    level = F.when(F.col("marked") & F.col("line").rlike(r"^#{1,6}\s+.+$"), F.length(F.regexp_extract("line", r"^(#{1,6})", 1)))
    opens = F.when(F.col("marked"), level.isNotNull() & F.col("body").rlike(EOL_OPENS) & ~F.col("body").rlike(EOL_OTHER)).otherwise(F.col("body").rlike(r"^end of support\s*$") & ~F.col("line").startswith("-"))
    topic = F.when(F.col("marked"), level.isNotNull() & F.col("body").rlike(EOL_CLOSES)).otherwise(F.col("body").rlike(EOL_PLAIN_CLOSES))
    event = own.withColumns({"level": F.coalesce(level, F.lit(0)), "opens": opens, "topic": topic}).filter("opens or topic or level > 0")
    # headings of a text are few; what state they leave is worked out over them alone: (open, level, number of the section)
    state = F.struct(F.lit(False).alias("open"), F.lit(0).alias("level"), F.lit(0).alias("section"), F.lit(-1).alias("at"))

    def step(s: Column, e: Column) -> Column:
        shuts = s["open"] & (e["topic"] | (e["level"] < s["level"]))
        still = s["open"] & ~shuts
        starts = e["opens"] & ~still
        return F.struct((still | starts).alias("open"), F.when(starts, e["level"]).otherwise(s["level"]).alias("level"), (s["section"] + F.when(starts, 1).otherwise(0)).alias("section"), e["at"].alias("at"))

    heads = event.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("at", "level", "opens", "topic"))).alias("e"))
    prefix = F.transform(F.sequence(F.lit(1), F.size("e")), lambda n: F.aggregate(F.slice("e", F.lit(1), n), state, step))
    marks = heads.select("version", F.explode(prefix).alias("s")).select("version", F.col("s.at").alias("at"), F.when(F.col("s.open"), F.col("s.section")).otherwise(0).alias("section"), F.lit(True).alias("head"))
    filled = forward_fill(own.join(marks, ["version", "at"], "left"), ["version"], "at", ["section"])
    title = ~F.col("marked") & ~F.col("line").rlike(r"^[-*]") & (F.length("line") < 72) & ~F.col("line").contains(".") & ~F.lower("line").rlike(EOL_KEEPS) & (F.size(F.split("line", r"\s+")) <= 8)
    kept = filled.filter((F.col("section") > 0) & F.col("head").isNull() & (F.length("line") > 3) & ~title)
    return topk_per_group(kept, ["version", "section"], ["at"], most).select("version", "section", "at", F.col("line").alias("entry"))


def endpoint_types(notes: DataFrame, names: Sequence[str], col: str = "text") -> DataFrame:
    """Distinct endpoint names that a text mentions; at each place the longest counts. All names are looked for in one pass."""
    return with_longest(notes, col, names, "endpoints")


def version_key(col: str) -> Column:
    """`May 2025` as 202505, null for other texts."""
    month = F.coalesce(*[F.when(F.col(col).rlike(rf"(?i)\b{m}\b"), F.lit(k + 1)) for k, m in enumerate(MONTHS)])
    return found(col, r"(20\d{2})").cast("int") * 100 + month


#: Components that are any endpoint's.
GENERIC = ("server", "engine", "sorter", "log stream", "security", "batch optimized apply", "common", "general", "setup")


def contains_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, needle) where a distinct text contains a distinct needle (columns text and needle; neither null nor empty).

    They meet by a needle's first three characters (or all, if it has fewer) and those that stand at any place of a text; then the whole is looked for."""
    own = texts.select("text").filter("text <> ''").distinct()
    place = own.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("p"))
    grams = place.select("text", F.explode(F.array(*[F.substring(F.col("text"), F.col("p"), F.lit(n)) for n in (1, 2, 3)])).alias("gram")).distinct()
    first = needles.select("needle").filter("needle <> ''").distinct().withColumn("gram", F.substring("needle", 1, 3))
    return grams.join(first, "gram").filter(F.contains("text", F.col("needle"))).select("text", "needle").distinct()


def endpoint_matches(texts: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(endpoint, text) of lower-case texts (text) that name an endpoint (endpoint), whole or by one of its words of more than three letters."""
    keys = endpoints.select(F.lower("endpoint").alias("endpoint")).filter("endpoint <> ''").distinct()
    parts = F.array_union(F.array("endpoint"), F.filter(F.split("endpoint", r"\s+"), lambda p: F.length(p) > 3))
    needles = keys.select("endpoint", F.explode(parts).alias("needle"))
    return contains_pairs(texts, needles).join(needles, "needle").select("endpoint", "text").distinct()


def _since(rows: DataFrame, files: DataFrame, name: str, order: list, k: int) -> DataFrame:
    """The first k of rows (endpoint, name, key, ...) for each distinct endpoint and month (own) of files: those of its month, of later ones and without a month; each name once, by its
    first row in order. Rows that an earlier one of the same name hides from a month are known by the months between which they count."""
    w = W.partitionBy("endpoint", name)
    # hidden from months up to that of the row before; an undated one hides all later ones
    before = F.lag(F.coalesce("key", F.lit(-1))).over(w.orderBy(F.asc_nulls_first("key"), *order))
    undated = F.max(F.col("key").isNull()).over(w) & F.col("key").isNotNull()
    shown = rows.withColumn("_before", F.when(undated, -1).otherwise(before))
    pairs = files.select("own", F.col("endpoint").alias("_e")).distinct()
    met = pairs.join(shown, F.col("_e") == F.col("endpoint")).drop("_e")
    counts = F.col("key").isNull() & F.col("_before").isNull() | (F.col("own").isNull() & F.col("_before").isNull()) | ((F.col("key") >= F.col("own")) & (F.col("_before").isNull() | ((F.col("_before") >= 0) & (F.col("_before") < F.col("own")))))
    return topk_per_group(met.filter(counts).drop("_before"), ["own", "endpoint"], [F.asc_nulls_first("key"), *order], k)


def _file_keys(files: DataFrame) -> DataFrame:
    """file_id, own (its version's month) and endpoint in lower case, `*` without one."""
    return files.select("file_id", version_key("version").alias("own"), F.coalesce(F.nullif(F.trim(F.lower("endpoint")), F.lit("")), F.lit("*")).alias("endpoint"))


#: Files of one month and endpoint that meet one copy of its list, about.
ASKERS = 10_000


def _each_file(keys: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows of lists (own, endpoint, ...) for each file (file_id, own, endpoint) that asks for them. A list is one row until it has met its files, which nothing sorts afterwards; that of many
    files is copied once for about ASKERS of them, so that no task has them all. Which lists those are is known to every task: a row for thousands of files."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ask = lambda df: df.withColumns({"own": F.coalesce("own", F.lit(0))})
    more = [c for c in lists.columns if c not in ("own", "endpoint")]
    many = F.broadcast(ask(keys).groupBy("own", "endpoint").agg(F.ceil(F.count("*") / F.lit(ASKERS)).cast("int").alias("_copies")).filter("_copies > 1"))
    whole = ask(lists).groupBy("own", "endpoint").agg(F.collect_list(F.struct(*more)).alias("_list")).join(many, ["own", "endpoint"], "left")
    copied = whole.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    files = ask(keys).join(many, ["own", "endpoint"], "left").withColumn("_copy", F.pmod(F.xxhash64("file_id"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    on = ["own", "endpoint", "_copy"]
    met = files.repartition(parts, *on).join(copied.repartition(parts, *on).hint("merge"), on)
    return met.select("file_id", F.inline("_list"))


def relevant_fixes(fixes: DataFrame, files: DataFrame, k: int = 30) -> DataFrame:
    """The first k fixes (fix_id, version, component, ...) for each file (file_id, version, endpoint): of its version and later ones, the oldest first; those of versions that are not months come before.

    Of a file with an endpoint, only fixes whose component names it (specific), or is one of those that are any endpoint's. A fix counts once, with its first version that
    is not older than the file's. future says that it came after the file's version. Files ask by endpoint and month, of which there are few; no file meets all fixes."""
    keys = _file_keys(files)
    named = fixes.withColumns({"key": version_key("version"), "_comp": F.lower(F.coalesce("component", F.lit("")))})
    match = endpoint_matches(named.select(F.col("_comp").alias("text")).filter(~F.col("_comp").isin(*GENERIC)), keys.select("endpoint").filter("endpoint <> '*'"))
    specific = named.join(match, F.col("_comp") == F.col("text")).drop("text").withColumn("specific", F.lit(True))
    general = named.withColumns({"endpoint": F.lit("*"), "specific": F.lit(False)})
    shared = named.filter(F.col("_comp").isin(*GENERIC)).withColumns({"endpoint": F.lit("?"), "specific": F.lit(False)})
    rows = specific.unionByName(general).unionByName(shared).drop("_comp")
    asks = written(keys.select("own", "endpoint").distinct())
    wanted = asks.select("own", "endpoint", F.explode(F.when(F.col("endpoint") == "*", F.array("endpoint")).otherwise(F.array("endpoint", F.lit("?")))).alias("_list"))
    lists = _since(rows, wanted.select("own", F.col("_list").alias("endpoint")), "fix_id", ["fix_id", "version"], k).withColumnsRenamed({"own": "_own", "endpoint": "_endpoint"})
    met = wanted.join(lists, F.col("own").eqNullSafe(F.col("_own")) & (F.col("_list") == F.col("_endpoint"))).drop("_own", "_endpoint", "_list")
    # a fix that both lists have, with two components, counts once: as one of the endpoint's own
    once = topk_per_group(met, ["own", "endpoint", "fix_id"], [F.desc("specific"), F.asc_nulls_first("key")], 1)
    ranked = topk_per_group(once, ["own", "endpoint"], [F.asc_nulls_first("key"), "fix_id"], k, "rank")
    out = ranked.withColumn("future", F.coalesce(F.col("key") > F.col("own"), F.lit(False)))
    return _each_file(keys, out)


def relevant_eol(entries: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """The first k entries on the end of support (version, section, at, entry) for each file: of its version and later ones, the oldest first, once for each first 80 characters; of a file with an
    endpoint, those that name it."""
    keys = _file_keys(files)
    e = entries.withColumns({"key": version_key("version"), "head": F.substring(F.trim("entry"), 1, 80), "_low": F.lower("entry")})
    match = endpoint_matches(e.select(F.col("_low").alias("text")), keys.select("endpoint").filter("endpoint <> '*'"))
    rows = e.join(match, F.col("_low") == F.col("text")).drop("text").unionByName(e.withColumn("endpoint", F.lit("*"))).drop("_low")
    lists = _since(rows, keys, "head", ["version", "section", "at"], k)
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("own", "endpoint").orderBy(F.asc_nulls_first("key"), "version", "section", "at")))
    return _each_file(keys, ranked).select("file_id", "rank", "version", "entry")


def fix_notes_by_version(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("version").agg(F.count("*").alias("entries"), F.array_sort(F.collect_set("component")).alias("components"))


def unseen_articles(found_urls: DataFrame, indexed: DataFrame) -> DataFrame:
    return found_urls.join(indexed.select("url"), "url", "left_anti")


def changed_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """What happened to each address: new, changed, same or gone, by digest."""
    a, b = old.select("url", F.col("content_hash").alias("old_hash")), new.select("url", F.col("content_hash").alias("new_hash"))
    return a.join(b, "url", "full_outer").withColumn("change", F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed"))


def _nearest(asked: np.ndarray, values: list[list], k: int, same: Sequence[str], ids: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best vectors that one task has for each query (row of asked) of a block, of those whose columns same are equal to the query's values.

    Vectors are looked at some at a time, whatever the batches hold, and never as Python's numbers."""
    code = [{x: n for n, x in enumerate(dict.fromkeys(x for x in column if x is not None))} for column in values]
    own = [np.array([-2 if x is None else c[x] for x in column]) for c, column in zip(code, values, strict=True)]
    length = np.sqrt(np.einsum("ij,ij->i", asked, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        bar = np.zeros(len(asked))
        for part in (b.slice(at, VECTORS) for b in batches for at in range(0, b.num_rows, VECTORS)):
            column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            fits = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(column["v"]), asked.shape[1]), False), pc.is_valid(column["id"]))
            if not (many := pc.sum(fits).as_py()):
                continue
            v = column["v"].filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(many, -1)
            names = column["id"].filter(fits)
            # the same sum for a pair wherever it stands, so that equal vectors are equally near
            dots, norms = np.einsum("ij,kj->ik", asked, v), np.sqrt(np.einsum("ij,ij->i", v, v))
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.maximum(dots / (length[:, None] * norms), 0.0)
            near[~np.isfinite(near)] = -1.0
            for c, q, kinds in zip(same, own, code, strict=True):
                near[q[:, None] != np.array([kinds.get(x, -1) for x in column[c].filter(fits).to_pylist()])] = -1.0
            for i in np.flatnonzero((near >= bar[:, None]).any(1)).tolist():
                kept = np.flatnonzero(near[i] >= bar[i])
                if len(kept) > k:
                    kept = kept[near[i, kept] >= np.partition(near[i, kept], len(kept) - k)[len(kept) - k]]
                best[i] = sorted(best[i] + list(zip(near[i, kept].tolist(), names.take(pa.array(kept)).to_pylist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
                bar[i] = best[i][-1][0] if len(best[i]) == k else 0.0
        out = [(n, s, i) for n, found in enumerate(best) for s, i in found]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int32(), pa.float64(), ids))], ["_n", "similarity", "id"])

    return run


#: Queries that go over the vectors at once, and vectors that they meet at a time.
QUERY_BLOCK, VECTORS = 512, 1024


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, same: Sequence[str] = ()) -> DataFrame:
    """The k vectors (id, v) nearest to each query (query_id, q) by cosine distance among those with equal metadata; similarity is 1 less the distance, 0 at least.

    Queries go over the vectors in blocks of a fixed number, one reading each. A task keeps the k best of what it reads for each query, so that no more than k rows a task and
    query are shuffled. Vectors or queries of another width, null, of length 0 or with parts that are not numbers take no part; ties go by id."""
    spark, out = queries.sparkSession, []
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), *same).filter("q is not null and size(q) > 0 and not exists(q, x -> x is null)")
    numbered = written(asked.withColumn("_at", F.monotonically_increasing_id()))
    own = vectors.select("id", F.col("v").cast("array<double>").alias("v"), *same)
    kind, ids = vectors.schema["id"].dataType.simpleString(), vectors.select("id").limit(0).toArrow().schema.field("id").type
    held: list = []
    names = spark.createDataFrame([], queries.select("query_id").schema).withColumn("_n", F.lit(0))

    def search() -> None:
        for width in sorted({len(r["q"]) for r in held}):
            block = [r for r in held if len(r["q"]) == width]
            found = own.mapInArrow(_nearest(np.array([r["q"] for r in block], np.float64), [[r[c] for r in block] for c in same], k, same, ids), f"_n int, similarity double, id {kind}")
            who = spark.createDataFrame([(r["query_id"], n) for n, r in enumerate(block)], names.schema)
            out.append(found.join(F.broadcast(who), "_n"))
        held.clear()

    for r in numbered.orderBy("_at").toLocalIterator():
        held.append(r.asDict())
        if len(held) >= QUERY_BLOCK:
            search()
    search()
    every = reduce(DataFrame.unionByName, out) if out else own.limit(0).select(F.lit(0).alias("_n"), F.lit(0.0).alias("similarity"), "id").join(names, "_n")
    return topk_per_group(every, ["query_id"], [F.desc("similarity"), "id"], k, "rank").select("query_id", "rank", "id", "similarity")


def collections_topk(queries: DataFrame, collections: dict[str, DataFrame], k: int = 5, same: Sequence[str] = ()) -> DataFrame:
    """The 2 k best of what several collections of vectors each have among their k nearest, with the collection's name."""
    found = [vector_topk(queries, v, k, same).withColumn("collection", F.lit(name)).drop("rank") for name, v in collections.items()]
    return topk_per_group(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("similarity"), "collection", "id"], 2 * k, "rank").select("query_id", "rank", "collection", "id", "similarity")


def fuse_matches(matches: DataFrame, k: int = 3) -> DataFrame:
    """Matches above the threshold (lower where the query has a code), code hits lifted, the best k, with confidence."""
    least = F.when(F.col("has_code"), 0.15).otherwise(0.3)
    scored = matches.filter(F.col("similarity") >= least).withColumn("score", F.col("similarity") + F.when(F.col("code_in_text"), 0.2).otherwise(0.0))
    return topk_per_group(scored, ["query_id"], [F.desc("score"), "id"], k, "rank").withColumn("confident", F.first("similarity").over(W.partitionBy("query_id").orderBy("rank")) > 0.6)


#: How alike an article must be, and how many of the nearest are looked at, by what is asked: one error code, a question without a file, an issue.
SIBLINGS = {"code": (0.25, 2), "no_file": (0.4, 2), "issue": (0.5, 5)}


def sibling_matches(matches: DataFrame, kind: str) -> DataFrame:
    """Of the nearest matches (query_id, id, similarity) to questions of a kind, those above its threshold; for a code, confident says high where the file has it (occurrences > 0)."""
    least, k = SIBLINGS[kind]
    out = topk_per_group(matches, ["query_id"], [F.desc("similarity"), "id"], k, "rank").filter(F.col("similarity") > least)
    return out.withColumn("confidence", F.when(F.col("occurrences") > 0, "high").otherwise("medium")) if kind == "code" else out


def context_matches(matches: DataFrame, least: float = 0.22, k: int = 10) -> DataFrame:
    """Matches of a file's queries: the first for each address, k at most."""
    once = topk_per_group(matches.filter(F.col("similarity") >= least), ["file_id", "url"], [F.desc("similarity"), "query_id"], 1)
    return topk_per_group(once, ["file_id"], [F.desc("similarity"), "url"], k, "rank")


def embed_documents(facts: DataFrame) -> DataFrame:
    """Documents for a vector index (file_id, kind, text) with a stable id; equal ids once."""
    return facts.withColumn("id", F.concat_ws("_", F.col("file_id").cast("string"), "kind", F.substring(F.md5(F.col("text").cast("binary")), 1, 12))).dropDuplicates(["id"])


def vector_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("file_id", "kind").agg(F.count("*").alias("documents"))


#: Sections that a report must have, and patterns of what it must and must not say.
REQUIRED_SECTIONS = ("Executive Summary", "Key Findings", "Performance", "Issues", "Error", "Risk Assessment")
HEADER = r"(?m)^#{1,3}\s+\*?\*?([^*\n]+?)\*?\*?\s*$"
HEALTH_SCORE = r"(?is)\b[1-5]\s*/\s*5\b|Health Score.*?[1-5]\s*/\s*5"
VAGUE, COUNTED = r"(?i)\b(several|multiple|many)\b", r"(?i)\b(several|multiple|many)\b\s*[0-9×]"
CHART_CLAIM = r"(?i)latency over time graph|attached.*chart|as shown in the graph"
NUMBERED_SECTION = r"(?im)^\d+\.\s+\*\*(Executive Summary|Key Findings|Performance|Issues|Error|Risk Assessment)"
TRUNCATION = r"(?m)\S/{2,}\s*$"
NAMED_PARAM, CITED_LINE = r"`([a-zA-Z][a-zA-Z0-9_]*)`", r"(?i)\bLINE\s+(\d+)\b"


def grade_reports(reports: DataFrame, key: str, col: str = "text", params: DataFrame | None = None, valid_lines: DataFrame | None = None, counts: DataFrame | None = None, chart_attached: bool = False, passing: float = 0.85, least_sections: int = 4) -> DataFrame:
    """A column for each check of the rubric (null where it is not asked), score, max_score, normalized (their share) and passed, of each report (key).

    Asked only if their tables are given: names in backticks are among params (name); cited lines among valid_lines (key, line_number); and all counts (key, label, expected) stand in the
    text (reports without any are not asked). An empty report has no other check than non_empty and a score of 0 of 10. A report passes with a health score, enough sections and enough of all."""
    text = F.col(col)
    headers = F.transform(F.regexp_extract_all(text, F.lit(HEADER), F.lit(1)), lambda h: F.lower(F.trim(h)))
    contains = lambda n: lambda h: F.contains(h, F.lit(n.lower()))
    checks = {
        "markdown_h2_sections": (F.size(headers) >= 4) & ~text.rlike(NUMBERED_SECTION),
        "no_truncation_artifacts": ~text.rlike(TRUNCATION),
        **{f"section_{n.lower().replace(' ', '_')}": F.size(F.filter(headers, contains(n))) > 0 for n in REQUIRED_SECTIONS},
        "health_score_x_of_5": text.rlike(HEALTH_SCORE),
        "no_unsupported_chart_claims": ~text.rlike(CHART_CLAIM) | F.lit(chart_attached),
        "no_vague_counts": F.size(F.regexp_extract_all(text, F.lit(VAGUE), F.lit(1))) == F.size(F.regexp_extract_all(text, F.lit(COUNTED), F.lit(1))),
    }
    own = reports.withColumn("non_empty", F.coalesce(F.trim(col) != "", F.lit(False)))
    out = own.withColumns({n: F.when(F.col("non_empty"), c) for n, c in checks.items()})
    asked = {}
    if params is not None:
        named = own.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMED_PARAM), F.lit(1)))).alias("name"))
        asked["params_in_allowlist"] = named.join(params.select("name").distinct(), "name", "left_anti").select(key).distinct()
    if valid_lines is not None:
        cited = own.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CITED_LINE), F.lit(1)))).alias("n")).select(key, F.col("n").cast("long").alias("line_number"))
        asked["line_citations_valid"] = cited.join(valid_lines.select(key, "line_number").distinct(), [key, "line_number"], "left_anti").select(key).distinct()
    for n, wrong in asked.items():
        out = out.join(wrong.withColumn("_wrong", F.lit(True)), key, "left").withColumn(n, F.when(F.col("non_empty"), F.col("_wrong").isNull())).drop("_wrong")
    if counts is not None:
        told = counts.join(own.select(key, text.alias("_text")), key).groupBy(key).agg(F.every(F.contains("_text", F.col("expected").cast("string"))).alias("_told"))
        out = out.join(told, key, "left").withColumn("authoritative_counts_present", F.when(F.col("non_empty"), F.col("_told"))).drop("_told")
        asked["authoritative_counts_present"] = told
    every = [*checks, *asked]
    total = lambda names, c: reduce(lambda x, y: x + y, [F.when(c(n), 1).otherwise(0) for n in names])
    out = out.withColumns({"score": total(every, F.col), "max_score": F.when(F.col("non_empty"), total(every, lambda n: F.col(n).isNotNull())).otherwise(10)})
    sections = total([n for n in checks if n.startswith("section_")], F.col)
    out = out.withColumn("normalized", F.round(F.col("score") / F.col("max_score"), 4))
    return out.withColumn("passed", F.col("non_empty") & F.coalesce("health_score_x_of_5", F.lit(False)) & (sections >= least_sections) & (F.col("normalized") >= passing))


def report_sections(reports: DataFrame, key: str, col: str = "text") -> DataFrame:
    """Markdown as sections: heading, level and text."""
    rows = reports.select(key, F.posexplode(F.split(col, "\n")).alias("at", "line"))
    heading = F.col("line").rlike(r"^#{1,6}\s")
    filled = forward_fill(rows.withColumn("h", F.when(heading, F.struct("at", F.col("line").alias("head")))), [key], "at", ["h"])
    return filled.filter("h is not null").groupBy(key, "h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~heading, F.struct("at", "line")))), lambda x: x["line"]), "\n").alias("text")).select(key, F.col("h.at").alias("at"), F.length(F.regexp_extract("h.head", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("h.head", r"^#+\s*", "")).alias("section"), "text")


def invalid_line_citations(reports: DataFrame, errors: DataFrame, key: str = "file_id", col: str = "text") -> DataFrame:
    """Lines (counted from 0) that a report (key, file_id, text) cites, counted from 1, although no error of its file stands there."""
    number = F.explode(F.regexp_extract_all(col, F.lit(r"(?i)LINE (\d+)"), F.lit(1)))
    cited = reports.select(*dict.fromkeys((key, "file_id")), number.alias("n")).withColumn("line_number", F.col("n").cast("long") - 1).drop("n").distinct()
    return cited.join(errors.select("file_id", "line_number").distinct(), ["file_id", "line_number"], "left_anti")


def unknown_params(reports: DataFrame, allowed: DataFrame, key: str, col: str = "text") -> DataFrame:
    """Names in backticks that a table of parameters (name) does not have."""
    named = reports.select(key, F.explode(F.regexp_extract_all(col, F.lit(r"`([A-Za-z_]\w+)`"), F.lit(1))).alias("name")).distinct()
    return named.join(allowed.select("name").distinct(), "name", "left_anti")


def unified_tables(stats: DataFrame, maps: DataFrame) -> DataFrame:
    """Tables of apply statistics and of bulk maps side by side, zeros where one has none."""
    m = maps.groupBy("file_id", "table_name").agg(F.count("*").alias("map_operations"), F.sum("rows").alias("map_rows"))
    s = stats.select("file_id", "table_name", (F.col("total_inserts") + F.col("total_updates") + F.col("total_deletes") + F.col("total_merges")).alias("apply_operations"))
    return s.join(m, ["file_id", "table_name"], "full_outer").fillna(0)


def tuning_params(endpoints: DataFrame, params: DataFrame, names: Sequence[str], depth: int = 5) -> DataFrame:
    """Parameters (endpoint, name, value) of each endpoint (endpoint, based_on), inherited from what it is based on; the nearest wins."""
    chain = endpoints.select("endpoint", F.col("endpoint").alias("ancestor"), F.lit(0).alias("depth"))
    front = chain
    up = endpoints.select(F.col("endpoint").alias("ancestor"), "based_on").filter("based_on is not null")
    for d in range(1, depth + 1):
        front = front.join(up, "ancestor").select("endpoint", F.col("based_on").alias("ancestor"), F.lit(d).alias("depth"))
        chain = chain.unionByName(front)
    own = params.withColumnRenamed("endpoint", "ancestor").filter(F.col("name").isin(list(names)))
    return topk_per_group(chain.join(own, "ancestor"), ["endpoint", "name"], ["depth"], 1).select("endpoint", "name", "value", "depth")


#: Releases that go by numbers.
TRAINS = r"\b(6\.[456]|5\.5)\b"


def support_status(files: DataFrame, schedule: DataFrame, as_of: str) -> DataFrame:
    """Each file's row of the support schedule (release, end_date): that of the same month and year, else of the same numbered train, else one whose text contains the hint or is contained
    in it, the first in the order of release; and whether support has ended. Distinct hints are looked up, and files meet them by equality."""
    hints = files.select(F.lower(F.trim("release_hint")).alias("hint")).filter("hint <> ''").distinct()
    plan = schedule.select("release", "end_date", F.lower(F.trim("release")).alias("name"), version_key("release").alias("month"), found("release", TRAINS).alias("train"))
    month = hints.withColumn("own", version_key("hint")).join(plan, F.col("own") == F.col("month")).select("hint", "release", "end_date", F.lit(0).alias("rank"))
    train = hints.withColumn("own", found("hint", TRAINS)).join(plan, F.col("own") == F.col("train")).select("hint", "release", "end_date", F.lit(1).alias("rank"))
    outer = contains_pairs(plan.select(F.col("name").alias("text")), hints.select(F.col("hint").alias("needle"))).select(F.col("needle").alias("hint"), F.col("text").alias("name"))
    inner = contains_pairs(hints.select(F.col("hint").alias("text")), plan.select(F.col("name").alias("needle"))).select(F.col("text").alias("hint"), F.col("needle").alias("name"))
    inside = outer.unionByName(inner).join(plan, "name").select("hint", "release", "end_date", F.lit(2).alias("rank"))
    best = topk_per_group(month.unionByName(train).unionByName(inside), ["hint"], ["rank", "release"], 1)
    matched = files.withColumn("hint", F.lower(F.trim("release_hint"))).join(best, "hint").drop("hint")
    return matched.withColumn("out_of_support", F.lit(as_of).cast("date") > F.col("end_date"))


def kb_registry_stats(kb: DataFrame) -> DataFrame:
    return kb.groupBy("source", "status").agg(F.count("*").alias("articles"), F.sum("chunks_count").alias("chunks"))


def feedback_mismatch(fb: DataFrame) -> DataFrame:
    return fb.withColumn("mismatch", ~F.array_contains("suggested_sources", F.col("actual_source")))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def endpoint_aliases(df: DataFrame, aliases: DataFrame, col: str = "endpoint") -> DataFrame:
    """df with the aliases (name, alias) of its endpoint's name, without the words source, target and endpoint."""
    name = F.trim(F.regexp_replace(F.lower(F.col(col)), r"\b(source|target|endpoint)\b", ""))
    known = aliases.groupBy(F.lower("name").alias("_name")).agg(F.array_sort(F.collect_set(F.lower("alias"))).alias("aliases"))
    return df.withColumn("_name", name).join(known, "_name", "left").withColumn("aliases", F.array_union(F.array("_name"), F.coalesce("aliases", F.array().cast("array<string>")))).drop("_name")


#: Groups of components, and the columns that a keyword is looked for in.
GROUPS = {
    "Server / Engine": ("server", "engine", "common", "general", "setup"),
    "Security": ("security",),
    "Sorter": ("sorter",),
    "Logging": ("logging", "log stream"),
    "Apply / Load": ("batch optimized apply", "transactional apply", "full load"),
    "Metadata": ("metadata manager", "metadata"),
}
FIX_FIELDS = ("fix_id", "description", "component", "type", "version", "title", "case")


def component_group(col: str = "component", specific: Column | None = None) -> Column:
    """The group of a component: Endpoint-Specific where the fix names the file's endpoint, Other for none of the groups and without a component."""
    own = F.lower(F.col(col))
    named = F.coalesce(*[F.when(own.isin(*words), F.lit(g)) for g, words in GROUPS.items()], F.lit("Other"))
    sure = F.coalesce(specific, F.lit(False)) if specific is not None else F.lit(False)
    return F.when(F.coalesce(F.col(col), F.lit("")) == "", "Other").when(sure, "Endpoint-Specific").otherwise(named)


def filter_fixes(fixes: DataFrame, keyword: str = "") -> DataFrame:
    """Fixes with the keyword in any of their fields, whatever its case (all without one), and the group of their component; a column specific says that a fix names the endpoint."""
    every = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in FIX_FIELDS if c in fixes.columns]))
    specific = F.col("specific") if "specific" in fixes.columns else None
    return fixes.filter(F.contains(every, F.lit(keyword.lower()))).withColumn("group", component_group(specific=specific))


def kb_list(kb: DataFrame, source: str | None = None, status: str | None = None, search: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the articles (source, status, title, indexed_at, url) of a source and status whose title has the text, the newest first, then by address."""
    out = kb
    for c, wanted in (("source", source), ("status", status)):
        out = out.filter(F.col(c) == wanted) if wanted else out
    out = out.filter(F.contains(F.lower("title"), F.lit(search.lower()))) if search else out
    return out.orderBy(F.desc("indexed_at"), "url").offset((page - 1) * size).limit(size)


def file_context(docs: DataFrame, k: int = 5) -> DataFrame:
    """Documents of each file and kind, k at most."""
    return topk_per_group(docs, ["file_id", "kind"], ["id"], k)


def delete_file(docs: DataFrame, file_id: int) -> DataFrame:
    return docs.filter(F.col("file_id") != file_id)


def chunks_by_version(chunks: DataFrame, version: str) -> DataFrame:
    return chunks.filter(F.col("version") == version)


def versions(notes: DataFrame) -> DataFrame:
    """Distinct versions, the newest first."""
    return notes.select("version").distinct().withColumn("rank", F.row_number().over(W.orderBy(F.desc(version_key("version")), "version")))
