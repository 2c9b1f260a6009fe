"""Mixing of sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

DataFrame functions only. Each document draws an exponential key divided by
its quality weight; within a source the smallest keys come first. A source's
target is met by whole epochs of the source and, for the rest, by the prefix
of its documents in key order, of whose last one only the first words count.
Prefix sums go over buckets of keys first, so that only the one bucket in
which a source's prefix ends is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read, words_of

#: Weights of the sources in order, repeating; a document stands at most LIMIT times in a mix.
WEIGHTS, LIMIT = (5, 2, 1), 3
#: Buckets of keys within a source, at least, and rows of one about.
BUCKETS, BUCKET_ROWS = 1024, 1 << 16


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, qualities: DataFrame | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """Chooses how often each document stands in a mix of the sources.

    qualities: (id_col, quality), a positive weight for drawing; documents
    without one weigh 1, the smallest of several counts. Returns one row for
    each input row: id_col, size (words of its text; 0 if null), source_size,
    target (both of its source), taken (words: size times its repeats, and
    part), repeats, part (words taken from one more copy), and the columns of
    extra. Sources are ordered by code point,
    null last as a source of its own. Targets share the size of all
    documents by weight; none exceeds limit times its source's size, and
    what it would exceed is shared anew among the others by weight. A
    document is taken floor(target / source_size) times, and once more if it
    ends within what is left; the document in which that ends gives its first
    words, so a source misses its target by less than a word. Ties of keys go
    to the smaller id, then size. Equal rows are interchangeable. An empty
    table gives no rows.
    """
    cuts = Cuts(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), *(F.col(c).alias(f"extra_{c}") for c in extra))
    if qualities is not None:
        weighed = qualities.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("double").alias("quality"))
        rows = rows.join(weighed, "id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("double"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    key = -F.ln(uniform) / F.coalesce("quality", F.lit(1.0))
    # a null source stands apart from every string
    named = rows.withColumn("source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    keyed = cuts.write(named.withColumn("key", key).drop("quality"))
    n = max(BUCKETS, keyed.count() // BUCKET_ROWS)
    keyed = keyed.withColumn("bucket", F.least(F.lit(n - 1), F.floor((1 - F.exp(-F.col("key"))) * n)).cast("int"))
    buckets = cuts.write(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("sum")))
    targets = cuts.write(source_targets(buckets.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, limit))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    plan = starts.join(targets, "source").withColumn("epochs", epochs).withColumn("left", left)
    plan = plan.withColumn("whole", F.col("start") + F.col("sum") <= F.col("left")).withColumn("ends", ~F.col("whole") & (F.col("start") <= F.col("left")))
    plan = cuts.write(plan.select("source", "bucket", "start", "source_size", "target", "epochs", "left", "whole", "ends"))

    joined = keyed.join(plan, ["source", "bucket"])
    upto = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = joined.filter("ends").withColumn("room", F.col("left") - F.col("start") - F.sum("size").over(upto) + F.col("size"))
    last = last.withColumn("more", (F.col("room") >= F.col("size")).cast("long"))
    last = last.withColumn("part", F.when(F.col("more") == 0, F.greatest("room", F.lit(0).cast("long"))).otherwise(0)).drop("room")
    rest = joined.filter("not ends").withColumn("more", F.col("whole").cast("long")).withColumn("part", F.lit(0).cast("long"))
    repeats = F.col("epochs") + F.col("more")
    out = rest.unionByName(last).withColumn("repeats", repeats)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats") + F.col("part")).alias("taken"), "repeats", "part", *(F.col(f"extra_{c}").alias(c) for c in extra))


def first_words(text, n):
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n), "")


def source_targets(sources: DataFrame, weights: tuple[int, ...], limit: int) -> DataFrame:
    """Adds target to (source, source_size), one row for each source.

    In the order of limit * size / weight the sources at their limit come
    first: a source is at its limit if its share of what those before it
    leave is not below the limit.
    """
    place = F.row_number().over(Window.orderBy("source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("weight", weight).withColumn("cap", F.lit(limit) * F.col("source_size"))
    s = s.withColumns({"all": F.sum("source_size").over(every), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    s = s.withColumn("full", F.col("cap") * F.col("open") <= (F.col("all") - F.col("capped")) * F.col("weight"))
    # the first source below its limit fixes the shares of all that follow
    s = s.withColumn("share", F.first(F.when(~F.col("full"), F.struct((F.col("all") - F.col("capped")).alias("left"), F.col("open"))), ignorenulls=True).over(every))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("share.left").cast("double") * F.col("weight") / F.col("share.open"))
    return s.select("source", "source_size", target.alias("target"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Weights for drawing from labels (doc_id, quality): good documents 2, bad 0.5; others weigh 1."""
    return labels.filter("quality is not null and doc_id is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality"))


def op7_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"), qualities=quality_weights(read(spark, sf_dir, "labels"))).drop("repeats", "part")


OP7_SQL = r"""
with recursive d as (
  select doc_id, source is null as no_source, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    -ln((('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
      / coalesce(q.quality, 1.0) as key
  from documents left join (
    select doc_id, min(case when quality = 1 then 2.0::double else 0.5::double end) as quality
    from labels where quality is not null and doc_id is not null group by doc_id) q using (doc_id)),
s as (
  select no_source, source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
    case (row_number() over (order by no_source, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from d group by no_source, source),
shares as (
  select 0 as round, (select sum(source_size) from s)::double / (select sum(weight) from s)::double as share
  union all
  select round + 1,
    ((select sum(source_size) from s) - (select coalesce(sum(cap), 0) from s where cap <= shares.share * weight))::double
      / (select sum(weight) from s where cap > shares.share * weight)::double
  from shares where round < 50 and exists (select 1 from s where cap > shares.share * weight)),
t as (
  select no_source, source, source_size, cap, weight,
    case when cap <= (select max(share) from shares) * weight then cap::double
      else ((select sum(source_size) from s) - (select coalesce(sum(cap), 0) from s where cap <= (select max(share) from shares) * weight))::double * weight
        / (select sum(weight) from s where cap > (select max(share) from shares) * weight) end as target
  from s),
e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
o as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size + 0.5)::bigint as remaining,
    sum(d.size) over (partition by d.no_source, d.source order by d.key, d.doc_id, d.size rows unbounded preceding)::bigint - d.size as before
  from d join e using (no_source, source))
select doc_id, size::bigint as size, source_size, target,
  (size * epochs + greatest(0, least(size, remaining - before)))::bigint as taken
from o
"""
