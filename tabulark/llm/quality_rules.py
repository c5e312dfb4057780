"""Quality rules whose cutoffs come from the data: mergeable quantile sketches per language and source.

Every document gets whole-number measures. A sketch is a log-linear histogram: a value keeps its top
PRECISION bits, so a bucket is at most 1/32 of its value wide, and sketches merge by adding counts: in any
order, across partitions, and from sources up to a language. A measure's fences stand FENCE spreads
outside its quartiles; the spread is the distance of the quartiles, a quarter of the nearer one or the
measure's resolution, whichever is largest. (Lengths are compared by ratio, of at least 2 a spread.) A document stays if all its
measures lie within the fences of its language and source; a source with fewer than MIN_GROUP documents
of a language takes the fences of the language as a whole.

Defined results: null and blank texts have no words and never stay. Null languages and sources are
groups of their own. Rows with a null doc_id take part in the sketches and are judged too. Repeated rows
count each time and are judged alike. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

PRECISION, FENCE, MIN_GROUP = 6, 3, 50
WHITE = r"[ \t\n\f\r]+"
#: measure: (side that is a fault, resolution in its own unit)
RULES = {"n_words": ("low", 1), "word_length": ("both", 500), "symbols": ("high", 15), "capitals": ("high", 30), "repeated_lines": ("high", 100)}


def measures(docs: DataFrame) -> DataFrame:
    """Whole numbers: words, letters per 1000 words, and per 1000: symbols and capitals of the characters
    that aren't blank, lines that were there before of all lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("t"))
    dense = F.length(F.regexp_replace("t", WHITE, ""))
    blanks = F.size(F.filter(F.split("t", WHITE), lambda w: w != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    part = base.select(
        "doc_id", "lang", "source", blanks.alias("n_words"), dense.alias("dense"),
        F.length(F.regexp_replace("t", r"[\p{L}\p{N} \t\n\f\r]+", "")).alias("odd"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("up"),
        F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("own"),
    )
    per = lambda a, b: F.expr(f"coalesce(try_divide(1000L * ({a}) - (1000L * ({a})) % {b}, {b}), 0)").cast("long")
    return part.select(
        "doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"), per("dense", "n_words").alias("word_length"),
        per("odd", "dense").alias("symbols"), per("up", "dense").alias("capitals"), per("lines - own", "lines").alias("repeated_lines"),
    )


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketches of every language and source."""
    names = list(RULES)
    long = measured.where("n_words > 0").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in names])).alias("x")).select("lang", "source", "x.measure", "x.v")
    drop = F.greatest(F.lit(0), F.length(F.bin("v")) - PRECISION)
    return long.withColumn("bucket", F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), drop), drop)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(buckets: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """(lang, source, measure, low, high)."""
    size = F.sum("n").over(Window.partitionBy("lang", "source", "measure"))
    sized = buckets.withColumn("size", size)
    own = sized.where(F.col("size") >= min_group).select("lang", "source", F.lit(True).alias("own"), "measure", "bucket", "n")
    whole = buckets.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), F.lit(False).alias("own"), "measure", "bucket", "n")
    group = Window.partitionBy("lang", "source", "own", "measure")
    run = own.union(whole).withColumn("cum", F.sum("n").over(group.orderBy("bucket"))).withColumn("size", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("size") * q, F.col("bucket")))
    quart = run.groupBy("lang", "source", "own", "measure").agg(at(1).alias("q1"), at(3).alias("q3"))
    slack = F.create_map(*[x for m, (_, r) in RULES.items() for x in (F.lit(m), F.lit(r))])[F.col("measure")]
    spread = lambda q: F.greatest(F.col("q3") - F.col("q1"), F.floor(F.col(q) / 4), slack)
    side = F.create_map(*[x for m, (s, _) in RULES.items() for x in (F.lit(m), F.lit(s))])[F.col("measure")]
    ratio = F.col("q1") * F.col("q1") * F.col("q1") * F.col("q1") / (F.col("q3") * F.col("q3") * F.col("q3"))
    low = F.when(F.col("measure") == "n_words", F.least(F.floor(ratio), F.floor(F.col("q1") / 8))).when(side != "high", F.col("q1") - fence * spread("q1"))
    high = F.when(side != "low", F.col("q3") + fence * spread("q3"))
    return quart.select("lang", "source", "own", "measure", low.cast("long").alias("low"), high.cast("long").alias("high"))


def judged(docs: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """The measures of every document, with `kept` and the first rule that it breaks."""
    measured = materialize(measures(docs), "quality-measures")
    cut = fences(sketch(measured), min_group, fence)
    names = list(RULES)
    wide = cut.groupBy("lang", "source", "own").agg(*[F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{m}_{x}") for m in names for x in ("low", "high")])
    own, whole = wide.where("own").drop("own"), wide.where("not own").drop("own", "source")
    bounds = [f"{m}_{x}" for m in names for x in ("low", "high")]
    own, whole = own.select(F.col("lang").alias("ol"), F.col("source").alias("os"), *[F.col(b).alias("o_" + b) for b in bounds], F.lit(True).alias("own")), whole.select(F.col("lang").alias("wl"), *bounds)
    both = measured.join(own, measured["lang"].eqNullSafe(own["ol"]) & measured["source"].eqNullSafe(own["os"]), "left").join(whole, measured["lang"].eqNullSafe(whole["wl"]), "left")
    pick = lambda b: F.when(F.col("own"), F.col("o_" + b)).otherwise(F.col(b))
    broken = F.when(F.col("n_words") == 0, "n_words")
    for m, (side, _) in RULES.items():
        if side != "high":
            broken = broken.when(F.col(m) < pick(f"{m}_low"), m)
        if side != "low":
            broken = broken.when(F.col(m) > pick(f"{m}_high"), m)
    return both.select("doc_id", *[F.col(m) for m in names], broken.alias("broken"))


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """(doc_id, measures) of the documents that stay; see the module for each edge case."""
    return judged(docs, min_group, fence).where("broken is null").drop("broken")


SQL = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
p as (select doc_id, lang, source, len(list_filter(string_split_regex(t, '[ \t\n\f\r]+'), lambda w: w <> '')) as n_words,
        length(regexp_replace(t, '[ \t\n\f\r]+', '', 'g')) as dense, length(regexp_replace(t, '[\p{L}\p{N} \t\n\f\r]+', '', 'g')) as odd,
        length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as up, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') as l from d),
m as (select doc_id, lang, source, n_words::bigint as n_words, coalesce(1000 * dense // nullif(n_words, 0), 0)::bigint as word_length, coalesce(1000 * odd // nullif(dense, 0), 0)::bigint as symbols,
        coalesce(1000 * up // nullif(dense, 0), 0)::bigint as capitals, coalesce(1000 * (len(l) - len(list_distinct(l))) // nullif(len(l), 0), 0)::bigint as repeated_lines from p),
u as (select lang, source, unnest(['n_words', 'word_length', 'symbols', 'capitals', 'repeated_lines']) as measure, unnest([n_words, word_length, symbols, capitals, repeated_lines]) as v from m where n_words > 0),
b as (select lang, source, measure, (v // (2::bigint ** greatest(0, length(bin(v)) - 6))::bigint) * (2::bigint ** greatest(0, length(bin(v)) - 6))::bigint as bucket, count(*) as n from u group by all),
z as (select *, sum(n) over (partition by lang, source, measure) as size from b),
g as (select lang, source, true as own, measure, bucket, n from z where size >= 50 union all select lang, null, false, measure, bucket, sum(n) from b group by lang, measure, bucket),
c as (select *, sum(n) over (partition by lang, source, own, measure order by bucket) as cum, sum(n) over (partition by lang, source, own, measure) as size from g),
q as (select lang, source, own, measure, min(bucket) filter (cum * 4 >= size) as q1, min(bucket) filter (cum * 4 >= size * 3) as q3 from c group by all),
f as (select *, case measure when 'word_length' then 500 when 'symbols' then 15 when 'capitals' then 30 when 'repeated_lines' then 100 else 1 end as r from q),
h as (select lang, source, own, measure, case measure when 'n_words' then least(floor(q1::double * q1 * q1 * q1 / (q3::double * q3 * q3)), q1 // 8) when 'word_length' then q1 - 3 * greatest(q3 - q1, q1 // 4, r) end as low,
        case when measure <> 'n_words' then q3 + 3 * greatest(q3 - q1, q3 // 4, r) end as high from f),
j as (select m.*, x.measure, m.doc_id as id, case x.measure when 'n_words' then m.n_words when 'word_length' then m.word_length when 'symbols' then m.symbols when 'capitals' then m.capitals else m.repeated_lines end as v,
        case when o.own then o.low else w.low end as low, case when o.own then o.high else w.high end as high
      from m cross join (select unnest(['n_words', 'word_length', 'symbols', 'capitals', 'repeated_lines']) as measure) x
      left join h o on o.own and o.lang is not distinct from m.lang and o.source is not distinct from m.source and o.measure = x.measure
      left join h w on not w.own and w.lang is not distinct from m.lang and w.measure = x.measure where m.n_words > 0)
select doc_id, n_words, word_length, symbols, capitals, repeated_lines from j group by all having not bool_or(coalesce(v < low, false) or coalesce(v > high, false))
"""
