"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. A passage is a window of a text's terms, as long as a template, that holds a licence word;
windows start every eighth of the template's length, so that one lies nearly on any statement, and run over line
breaks. Passages and templates are sparse vectors of their terms, weighted by how few documents have them (counted
over all documents for all terms). A passage states the licence of a template if the cosine is SIMILAR or more and it
holds all words that name the licence in the template. An SPDX identifier states its licence by itself. A document
takes the licence of its best passage, or of a longer one that is within MARGIN of it; ``margin`` is its lead over the
best passage of another licence that is not a part of it. A document of LEAST_FILE words or more of which half are such passages, or whose file is named LICENSE, LICENCE or COPYING, is a licence
file and speaks for its directory, unless two licences are within MARGIN; a document with no licence of its own
inherits from the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import NAMING, TEMPLATES
from .shared import discard, materialize

TERM = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
#: Terms of which a window holds one.
ANCHOR = (
    r"licen[cs]|^(spdx|copyright|copying|reserved|permission|permitted|redistribution|creative|commons|cc0|cc|l?gplv?[0-9.]*|agplv?[0-9.]*|gnu|apache|mozilla|warranty|warranties|unencumbered"
    r"|bsd|wtfpl|gfdl|mpl|epl|cddl|eupl|ofl|afl|osl|lppl|mulanpsl|cecill|qpl|zpl|odbl|upl|sspl|busl)$"
)
#: A lower-case text, a space before it, without "licen" and without a match holds no such term: only words that begin like one are compared.
ANCHORED = (
    r"[^a-z](?:spdx|copy|reserved|permi|redistribution|creative|commons|gnu|apache|mozilla|warrant|unencumbered"
    r"|(?:cc0?|l?gplv?|agplv?|bsd|wtfpl|gfdl|mpl|epl|cddl|eupl|ofl|afl|osl|lppl|mulanpsl|cecill|qpl|zpl|odbl|upl|sspl|busl)(?![a-z]))"
)
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+\-]*\)*(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+\-]*\)*)*)"
#: What leads a name to be denied, within the BEFORE terms before a wording of at most SHORT terms or in it.
DENIED = r"(^| )(not|never|t|no longer) ((yet|currently|being) )?(licen[cs]ed|released|distributed|available|covered|published|offered|under)( |$)"
BEFORE, SHORT = 4, 16
SIMILAR, MARGIN, FILE_SHARE, LEAST_FILE = 0.6, 0.02, 0.5, 20
_NAME = r"(?i)(^|/)(licen[cs]e|copying)([.\-][^/]*)?$"


def terms(text: Column) -> Column:
    """Lower-case words and version numbers, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def template_terms(text: str) -> list[str]:
    """The terms of a template wording, which holds ASCII only."""
    return re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", text.lower())


def step_of(length: int) -> int:
    """How far apart the windows of a template start."""
    return max(1, length // 8)


def anchored(text: Column) -> Column:
    """Whether a text can hold a term of ANCHOR; some that cannot pass too."""
    low = F.lower(text)
    return F.contains(low, F.lit("licen")) | F.regexp_like(F.concat(F.lit(" "), low), F.lit(ANCHORED))


def document_counts(rows: DataFrame) -> DataFrame:
    """(term, df): in how many of the rows (text) a term occurs; the empty term counts the rows."""
    distinct = F.array_distinct(F.concat(terms(F.col("text")), F.array(F.lit(""))))
    return rows.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def passages(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Of texts (hash, terms, places of licence words) the passages: hash, start, size, license, template, score.

    Three sieves that lose none: a document and a template go on if the terms that they share can reach SIMILAR at
    all (by Cauchy and Schwarz), a window if it does with every other term weighing 1, the least, and the rest are
    scored with all weights.
    """
    spark = texts.sparkSession
    wordings = [Counter(template_terms(w)) for _, w in TEMPLATES]
    vocabulary = spark.createDataFrame([(w,) for w in sorted({"", *(w for c in wordings for w in c)})], "term string")
    df = {r.term: r.df for r in counts.join(F.broadcast(vocabulary), "term").collect()}  # rows of the fixed templates' terms
    total = max(1, df.get("", 0))
    idf = {w: math.log(total / max(1, df.get(w, 0))) + 1 for c in wordings for w in c}
    vectors, known = [], []  # entries of the fixed templates: terms and weights of those without a name, and all with their vectors
    for k, (c, (name, _)) in enumerate(zip(wordings, TEMPLATES, strict=True)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        length = sum(c.values())
        must = sorted(c.keys() & set(NAMING), key=lambda w: (-idf[w], w))
        known.append((k, name, length, step_of(length), must, {w: (n * idf[w] / norm * idf[w], idf[w]) for w, n in c.items()}))
        if not must:
            vectors += [(k, w, (n * idf[w] / norm) ** 2) for w, n in sorted(c.items())]
    vectors = spark.createDataFrame(vectors, "template int, term string, share double")
    known = spark.createDataFrame(known, "template int, license string, length int, step int, must array<string>, v map<string,struct<dot:double,weight:double>>")

    # A template that names a licence is looked up by the rarest of its naming words, any other by all of its terms.
    held = texts.select("hash", F.explode(F.array_distinct("terms")).alias("term"))
    nameless = held.join(F.broadcast(vectors), "term").groupBy("hash", "template").agg(F.sum("share").alias("share")).where(F.col("share") >= SIMILAR**2 - 1e-9).select("hash", "template")
    named = held.join(F.broadcast(known.where(F.size("must") > 0).select(F.col("must")[0].alias("term"), "template")), "term").select("hash", "template")
    near = texts.join(nameless.union(named), "hash").join(F.broadcast(known), "template").where(F.size(F.array_except("must", "terms")) == 0)
    shared = F.aggregate(F.array_intersect(F.map_keys("v"), "terms"), F.lit(0.0), lambda n, t: n + F.pow(F.element_at("v", t)["dot"] / F.element_at("v", t)["weight"], F.lit(2.0)))
    near = near.where(shared >= SIMILAR**2 - 1e-9)
    first = F.ceil(F.greatest(F.lit(0), F.col("place") - F.col("length") + 1) / F.col("step")) * F.col("step")
    near = near.select("hash", "template", "license", "length", "step", "must", "v", "terms", F.explode("places").alias("place"))
    near = near.withColumn("start", F.explode(F.sequence(first.cast("int"), (F.floor(F.col("place") / F.col("step")) * F.col("step")).cast("int"), "step")))
    window = near.select("hash", "template", "license", "must", "v", "start", F.slice("terms", F.col("start") + 1, F.col("length")).alias("window"), "length", "terms")
    window = window.where(F.size(F.array_except("must", "window")) == 0)
    led = F.array_join(F.concat(F.slice("terms", F.greatest(F.lit(1), F.col("start") + 1 - BEFORE), F.least(F.lit(BEFORE), F.col("start"))), "window"), " ")
    after = F.array_join(F.slice("terms", F.col("start") + 1, F.col("length") + 1), " ")
    denied = ((F.col("length") <= SHORT) & F.regexp_like(led, F.lit(DENIED))) | ((F.col("license") == "Proprietary") & F.regexp_like(after, F.lit(r"reserved (to|for)( |$)")))
    window = window.where(~denied).drop("length", "terms").dropDuplicates(["hash", "template", "start"])
    dot = F.aggregate("window", F.lit(0.0), lambda n, t: n + F.coalesce(F.element_at("v", t)["dot"], F.lit(0.0)))
    least = F.aggregate("window", F.lit(0.0), lambda n, t: n + F.coalesce(F.pow(F.element_at("v", t)["weight"], F.lit(2.0)), F.lit(1.0)))
    window = window.withColumn("dot", dot).where(F.col("dot") >= (SIMILAR - 1e-6) * F.sqrt(least)).select("hash", "template", "license", "start", "dot", "window")
    window = materialize(window, "windows")
    key = ["hash", "template", "license", "start", "dot", "size"]
    count = lambda t: F.struct(t.alias("term"), F.size(F.filter("window", lambda x: x == t)).alias("tf"))
    each = window.withColumn("size", F.size("window")).select(*key, F.explode(F.transform(F.array_distinct("window"), count)).alias("t")).select(*key, "t.term", "t.tf")
    weight = F.log(F.lit(float(total)) / F.col("df")) + 1
    norms = each.join(counts, "term").groupBy(*key).agg(F.sqrt(F.sum(F.pow(F.col("tf") * weight, F.lit(2.0)))).alias("norm"))
    scored = norms.select("hash", "start", "size", "license", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    return scored.where(F.col("score") >= SIMILAR)


def scan(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, path, text) to doc_id, path, license, score, margin, origin.

    origin is "own", "inherited" or null; score is the cosine of the best passage, own or of the licence file
    inherited from, and margin its lead over the best passage of another licence there. Ties go to the earlier
    template and place, and among licence files of a directory to the higher score, then the smaller hash of the path. Null or
    empty text has no licence of its own; a null path is a file of no directory; repeated rows are each returned
    and each count in the document frequencies; equal texts are compared once; of a very long text only windows
    around licence words are compared; an empty table gives an empty one; other columns are ignored.
    """
    rows = documents.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(document_counts(rows), "term-counts")
    # A text is known by its digest; one without a licence word has none and is compared with nothing.
    digest = F.sha2("text", 256)
    keys = materialize(rows.select("doc_id", "path", F.when(anchored(F.col("text")), digest).alias("hash")), "row-digests")
    held = rows.where(anchored(F.col("text"))).select(digest.alias("hash"), "text").dropDuplicates(["hash"])
    plain = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(-only|-or-later|\+|[.\-]+)(?=[ )]|$)", "")
    spdx = F.regexp_replace(F.regexp_replace(plain, r"^\(([^()]*)\)$", "$1"), r"[ \t]+", " ")
    held = held.select("hash", terms(F.col("text")).alias("terms"), spdx.alias("spdx"))
    places = F.filter(F.transform("terms", lambda t, k: F.when(F.regexp_like(t, F.lit(ANCHOR)), k)), lambda k: k.isNotNull())
    texts = materialize(held.withColumn("places", places).where(F.size("places") > 0), "licence-texts")
    found = materialize(passages(texts.select("hash", "terms", "places"), counts), "passages")
    named = texts.where("spdx <> ''").select("hash", F.lit(-1).alias("start"), F.lit(0).alias("size"), F.col("spdx").alias("license"), F.lit(-1).alias("template"), F.lit(1.0).alias("score"))
    each = found.union(named)
    # Of the passages within MARGIN of the best one the longest says most; an identifier says all.
    tops = each.groupBy("hash").agg(F.max("score").alias("top"))
    order = F.struct((F.col("template") < 0).alias("identifier"), "size", "score", (-F.col("template")).alias("t"), (-F.col("start")).alias("s"), "license")
    best = each.join(tops, "hash").where(F.col("score") >= F.col("top") - MARGIN).groupBy("hash").agg(F.max(order).alias("b"))
    best = best.select("hash", "b.license", "b.score", (-F.col("b.s")).alias("from"), (F.col("b.size") - F.col("b.s")).alias("to"))
    within = (F.col("e.start") >= F.col("b.from")) & (F.col("e.start") + F.col("e.size") <= F.col("b.to"))
    others = each.alias("e").join(best.alias("b"), "hash").where((F.col("e.license") != F.col("b.license")) & ~within).groupBy("hash").agg(F.max("e.score").alias("other"))
    best = best.join(others, "hash", "left").select("hash", "license", "score", (F.col("score") - F.coalesce("other", F.lit(0.0))).alias("margin"))
    said = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))))
    covered = found.groupBy("hash", "license").agg(said.alias("covered"))
    sizes = texts.select("hash", F.size("terms").alias("words"))
    own = best.join(covered, ["hash", "license"], "left").join(sizes, "hash").select("hash", "license", "score", "margin", F.when(F.col("words") >= LEAST_FILE, F.col("covered") / F.col("words")).alias("share"))
    own = keys.join(own, "hash").distinct()
    own = materialize(own, "own-licenses")
    for table in (counts, texts, found):
        discard(table)

    one = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "path", "hash")]
    folder = lambda path: F.regexp_replace(path, "(^|/)[^/]*$", "")
    speaks = own.where((F.col("path").isNotNull()) & (F.col("margin") >= MARGIN) & (F.coalesce(F.col("share") >= FILE_SHARE, F.lit(False)) | F.regexp_like("path", F.lit(_NAME))))
    folders = speaks.groupBy(folder(F.col("path")).alias("folder")).agg(F.max_by(F.struct("license", "score", "margin"), F.struct("score", (-F.xxhash64("path")).alias("h"))).alias("given"))
    places = keys.where("path is not null").select(folder(F.col("path")).alias("place")).distinct()
    names = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(names, F.lit(1), k), "/").alias("folder")))
    ways = places.select("place", F.explode(above).alias("up")).select("place", "up.depth", "up.folder")
    nearest = ways.join(folders, "folder").groupBy("place").agg(F.max_by("given", "depth").alias("given"))
    mine = keys.alias("a").join(own.alias("b"), one[0] & one[1] & one[2], "left").select("a.doc_id", "a.path", "b.license", "b.score", "b.margin")
    mine = mine.withColumn("place", folder(F.col("path"))).join(nearest, "place", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    return mine.select("doc_id", "path", F.coalesce("license", "given.license").alias("license"), F.coalesce("score", "given.score").alias("score"), F.coalesce("margin", "given.margin").alias("margin"), origin.alias("origin"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000), "doc_id")
    return scan(rows.select("doc_id", path.alias("path"), "text"))
