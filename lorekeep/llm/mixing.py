"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words gives every document floor(r) certain copies. The words still wanted are a
sample of unequal probabilities: a document's inclusion probability p grows with its length (p = scale * length,
the length rounded down to ``LENGTH_BITS`` binary digits), stops at 1, and the scale is such that the expected words of
the sample are those wanted. Documents with p = 1 get one certain copy more. The others are ranked by
(U / (1 - U)) / (p / (1 - p)), with U uniform by the document's id and text, and taken in rank order up to a fixed
size in words.

Nothing is sorted by source: the scale comes from a table of at most some thousand distinct rounded lengths per source,
and the cut from ``LEVELS`` histograms of ``BINS`` bins each over the rank, every one inside the bin of the one before
where the sample ends; only the rows of the last bin are put in order, equal ones as one row with their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, packed, table, unit_hash, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
GROWTH = 1.5
MAX_REPEAT = 2
LENGTH_BITS = 5
BINS, LEVELS = 256, 3
SEED = 7
#: The rates of up to so many sources (a row of numbers each) are broadcast, so that no row moves to a source's task.
BROADCAST_SOURCES = 10_000
#: Parts in which equal rows at a source's cut are numbered.
TIE_PARTS = 256


#: The columns that an allocation reads; all others are carried along.
KEYS = ("doc_id", "source", "text")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def rank_unit(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """U of a row: a number in [0, 1) by its id, its text and the seed alone."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    return unit_hash(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), digest), seed)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, growth: float = GROWTH, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target from (source, source_size), a row per source.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share growth times all words by weight,
    but stop at max_repeat times a source's size; with sources in the order of size by weight those that
    stop come first, and the share of the others follows from the running sums before each."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    named = sizes.withColumn("weight", w).withColumns({"cap": (F.col("source_size") * max_repeat).cast("double"), "ratio": F.col("source_size") * max_repeat / w})
    rank = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = named.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(rank), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rank), F.lit(0.0)),
        "wanted": F.sum("source_size").over(everything) * growth,
    })
    level = (F.col("wanted") - F.col("cap_before")) / F.col("weight_left")
    # the first source that stays under its cap at its level sets the level of all after it
    first = F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level")))).over(everything)["level"]
    return ranked.withColumn("first", first).select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first"))).alias("target"))


def length_of(size: Column) -> Column:
    """The size rounded down to LENGTH_BITS binary digits: a few values for every doubling, however long texts are."""
    return size - F.pmod(size, F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - LENGTH_BITS, F.lit(0))).cast("long"))


def _few(sources: DataFrame) -> bool:
    return len(sources.select("source").take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES


def _by_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """``left`` with the columns of a row per source; equal null sources match. few: whether ``right`` may be broadcast."""
    named = right.withColumnRenamed("source", "__mix_source")
    return left.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")


def sampling_rates(lengths: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """A row per source: source, source_size, target, whole (certain copies of every document), scale (p = scale *
    length) and rest (words to be sampled). lengths: source, length, words, a row per rounded length.

    With the longest first, the documents before a length are those whose p has reached 1: the scale is that of the first length
    that stays at or under 1 with the words wanted less all before it."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = targets.withColumn("whole", F.floor(rate)).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = _by_source(lengths.where("length > 0"), known, few)
    key = [F.col("source").isNull(), F.col("source")]
    down, up = Window.partitionBy(*key).orderBy(F.desc("length")), Window.partitionBy(*key).orderBy("length")
    mass = (F.col("length").cast("decimal(20,0)") * F.col("words")).cast("decimal(38,0)")  # exact: reruns agree
    rows = rows.withColumns({
        "before": F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "mass": F.sum(mass).over(up.rowsBetween(Window.unboundedPreceding, 0)).cast("double"),
    })
    rows = rows.withColumns({"rest": F.col("wanted") - F.col("before"), "scale": (F.col("wanted") - F.col("before")) / F.col("mass")})
    first = rows.where(F.col("scale") * F.col("length") <= 1).groupBy(F.col("source").alias("__mix_of")).agg(F.max(F.struct("length", "scale", "rest")).alias("at"))
    out = known.join(first, F.col("source").eqNullSafe(F.col("__mix_of")), "left")
    zero = F.lit(0.0)
    return out.select("source", "source_size", "target", "whole", F.coalesce(F.greatest("at.scale", zero), zero).alias("scale"), F.coalesce(F.greatest("at.rest", zero), zero).alias("rest"))


def _place(scale: Column, size: Column, u: Column) -> tuple[Column, Column]:
    """p, and the place v in [0, 1) of the rank: odds / (1 + odds). Rows that are certain or never taken have no place."""
    p = F.least(scale * length_of(size), F.lit(1.0))
    return p, F.when((p > 0) & (p < 1), u * (1 - p) / (u * (1 - p) + p * (1 - u)))


def sampling_plan(sized: DataFrame) -> DataFrame:
    """A row per source: its size, target, rates and the cut of its sample. sized: source, size, u (see ``rank_unit``).

    Rows of (v, size) under (cut_v, cut_size) are taken, and of those equal to it, which number ``ties``, the first ``tie_taken``."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes), "mix-targets")
    few = _few(targets)
    lengths = sized.groupBy("source", length_of(F.col("size")).alias("length")).agg(F.sum("size").alias("words"))
    rates = materialize(sampling_rates(lengths, targets, few), "mix-rates")
    ranked = _by_source(sized, rates.select("source", "scale"), few)
    left = materialize(ranked.select("source", "size", _place(F.col("scale"), F.col("size"), F.col("u"))[1].alias("v")).where("v is not null"), "mix-ranks")
    key = [F.col("source").isNull(), F.col("source")]
    state = rates.select("source", "rest", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    for level in range(LEVELS):
        fine = F.floor(F.col("v") * float(BINS ** (level + 1))).cast("long")
        inside = _by_source(left, state.select("source", "rest", "before", F.col("bin").alias("outer")), few).withColumn("bin", fine).where(F.expr(f"bin div {BINS} = outer"))
        bins = inside.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.sum("words").over(Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.col("before") + F.coalesce(upto, F.lit(0))).where("before < rest")
        last = bins.groupBy("source").agg(F.max(F.struct("bin", "before", "rest")).alias("at"))
        state = last.select("source", "at.*")
    state = materialize(state, "mix-cut")
    inside = _by_source(left, state, few).where(F.floor(F.col("v") * float(BINS**LEVELS)).cast("long") == F.col("bin"))
    groups = inside.groupBy("source", "v", "size").agg(F.count("*").alias("ties"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.sum(F.col("ties") * F.col("size")).over(Window.partitionBy(*key).orderBy("v", "size").rowsBetween(Window.unboundedPreceding, -1))
    # a row is taken if the sample's end is past its middle
    fits = F.floor((F.col("rest") - F.col("before") - F.coalesce(upto, F.lit(0))) / F.col("size") + 0.5)
    groups = groups.withColumn("tie_taken", F.least(F.greatest(fits, F.lit(0)), F.col("ties")).cast("long")).where("tie_taken > 0")
    cut = groups.groupBy("source").agg(F.max(F.struct("v", "size", "tie_taken", "ties")).alias("cut"))
    at = state.join(cut.withColumnRenamed("source", "__mix_source"), F.col("source").eqNullSafe(F.col("__mix_source")), "left")
    edge = F.col("bin") / float(BINS**LEVELS)  # no row of the last bin fits: all before it
    at = at.select(F.col("source").alias("__mix_source"), F.coalesce("cut.v", edge).alias("cut_v"), F.coalesce("cut.size", F.lit(0)).cast("long").alias("cut_size"), F.coalesce("cut.tie_taken", F.lit(0)).alias("tie_taken"), F.coalesce("cut.ties", F.lit(0)).alias("ties"))
    return materialize(rates.join(at, F.col("source").eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source"), "mix-plan")


def allocate(docs: DataFrame, plan: DataFrame, seed: int = SEED, into: str = "__mix") -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with one more column, the struct ``into``: size, source_size,
    target, p (inclusion probability of the sampled copy) and copies (0 to MAX_REPEAT, whole documents).

    Reruns agree: U depends on the id, the text and the seed. Rows equal in id and text have one rank; where a source's sample ends
    among them, only as many as fit are taken (which of them, is open). A null doc_id is an empty one, a null text has no words; a
    source of no words has target 0 and gives nothing; a document of no words has p = 0. Other columns are left as they
    are, whatever their names; a column ``into`` is replaced. An empty table gives an empty table."""
    columns, docs = docs.drop(into).columns, packed(docs.drop(into), *KEYS)
    rates = plan.select("source", F.struct(*[c for c in plan.columns if c != "source"]).alias("__mix_plan"))
    rows = _by_source(docs.withColumns({"__mix_size": n_words(), "__mix_u": rank_unit(seed)}), rates, _few(rates))
    p, v = _place(F.col("__mix_plan.scale"), F.col("__mix_size"), F.col("__mix_u"))
    rows = rows.withColumns({"__mix_p": p, "__mix_v": v})
    here, cut = F.struct(F.col("__mix_v").alias("v"), F.col("__mix_size").alias("size")), F.struct(F.col("__mix_plan.cut_v").alias("v"), F.col("__mix_plan.cut_size").alias("size"))
    tied = F.coalesce((here == cut) & (F.col("__mix_v").isNotNull()), F.lit(False))
    partly = tied & (F.col("__mix_plan.tie_taken") < F.col("__mix_plan.ties"))
    sampled = (F.col("__mix_p") >= 1) | F.coalesce((F.col("__mix_v").isNotNull()) & (here < cut), F.lit(False)) | (tied & ~partly)
    if plan.where("tie_taken < ties").isEmpty():
        rows = rows.withColumn("__mix_sampled", sampled)
    else:  # equal rows of a cut are numbered in parts, of which no one holds them all
        ties = materialize(rows.where(partly).withColumn("__mix_part", F.monotonically_increasing_id() % TIE_PARTS), "mix-ties")
        counts = ties.groupBy("source", "__mix_part").agg(F.count("*").alias("n"))
        ahead = Window.partitionBy(F.col("source").isNull(), "source").orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(F.col("source").alias("__mix_source"), F.col("__mix_part").alias("__mix_p2"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__mix_ahead"))
        nth = F.row_number().over(Window.partitionBy(F.col("source").isNull(), "source", "__mix_part").orderBy(F.lit(1)))
        ties = ties.withColumn("__mix_nth", nth).join(counts, F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_part") == F.col("__mix_p2")))
        ties = ties.withColumn("__mix_sampled", F.col("__mix_ahead") + F.col("__mix_nth") <= F.col("__mix_plan.tie_taken"))
        rows = rows.where(~partly).withColumn("__mix_sampled", sampled)
        rows = rows.unionByName(ties.select(*rows.columns))
    copies = (F.col("__mix_plan.whole") + F.col("__mix_sampled").cast("int")).cast("int")
    made = F.struct(F.col("__mix_size").alias("size"), F.col("__mix_plan.source_size").alias("source_size"), F.col("__mix_plan.target").alias("target"), F.col("__mix_p").alias("p"), copies.alias("copies"))
    return unpacked(rows, columns, KEYS, made.alias(into))


def plan_for(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The sampling plan of a table (doc_id, source, text)."""
    return sampling_plan(materialize(docs.select("source", n_words().alias("size"), rank_unit(seed).alias("u")), "mix-sizes"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and any others), each as often as the mix takes it."""
    rows = allocate(packed(docs, *KEYS), plan_for(docs, seed), seed, "__mix")
    return unpacked(rows.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix.copies")))), docs.columns, KEYS)


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = allocate(docs, plan_for(docs))
    return rows.select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", (F.col("__mix.size") * F.col("__mix.copies")).alias("taken"))


OP6_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5(coalesce(text, '')) as digest from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
r as (select *, cast(source_size * 2 as double) as cap, source_size * 2 / weight as ratio from w),
k as (select *, coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as cap_before,
  sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as weight_left,
  cast(sum(source_size) over () as double) * 1.5::double as wanted from r),
l as (select *, (wanted - cap_before) / weight_left as level from k),
f as (select min(ratio) as ratio from l where level <= ratio),
t as (select l.source, l.source_size, case when (select ratio from f) is null then l.cap else least(l.cap, l.weight * (select min(level) from l where ratio = (select ratio from f) and level <= ratio)) end as target from l),
p as (select *, floor(case when source_size > 0 then target / source_size else 0 end) as whole from t),
e as (select d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as wanted,
  size - size % cast(pow(2, greatest(length(bin(size)) - 5, 0)) as bigint) as length from d join p on d.source is not distinct from p.source),
g as (select source, length, max(wanted) as wanted, cast(sum(size) as bigint) as words from e where length > 0 group by source, length),
h as (select *, wanted - coalesce(sum(words) over (partition by source order by length desc rows between unbounded preceding and 1 preceding), 0) as rest,
  cast(sum(length * words) over (partition by source order by length rows between unbounded preceding and current row) as double) as mass from g),
q as (select source, arg_max(greatest(rest, 0.0), length) as rest, arg_max(greatest(rest / mass, 0.0), length) as scale from h where rest / mass * length <= 1 group by source),
u as (select e.*, coalesce(q.rest, 0.0) as rest, least(coalesce(q.scale, 0.0) * length, 1.0) as pi,
  cast(cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || digest), 1, 13) as bigint) as double) / 4503599627370496.0::double as u
  from e left join q on e.source is not distinct from q.source),
v as (select *, case when pi > 0 and pi < 1 then u * (1 - pi) / (u * (1 - pi) + pi * (1 - u)) end as v from u),
c as (select *, sum(case when v is not null then size else 0 end) over (partition by source order by v, size rows between unbounded preceding and current row) as upto from v)
select doc_id, size, source_size, target, cast(size * (whole + case when pi >= 1 then 1 when v is not null and 2 * upto - size <= 2 * rest then 1 else 0 end) as bigint) as taken from c
"""
