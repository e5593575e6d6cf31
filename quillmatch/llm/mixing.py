"""2. Mixing sources to target weights, by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.common import Scratch, table, unused, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Rows repeated whole that one task tells apart at a time.
PIECE = 1000
JUNK = "#*$%&|<>{}[]\\~^_=+@0123456789"


def quality(text: Column) -> Column:
    """Sampling weight from 1 to 4: 4 for text without marks and digits, 1 from a tenth of them on; 1 for null and empty."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.when(n > 0, 4 - 3 * F.least(F.lit(1.0), 10 * marks / n)), F.lit(1.0))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that id and text alone decide, the same in each run; null has one too."""
    said = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(said, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def targets(totals: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals (source, source_size, n_docs) with rank, target, epochs, left and buckets for each source.

    Sources in order of code points, null last, weigh ``weights``, repeating. Together they get ``share`` of all sizes;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.
    With sources in order of cap per weight, those that reach their cap come first, so running sums tell the level at
    which the rest share, without a loop. There is a row for each source here, not for each document, so
    windows over all of them are small.
    """
    all_rows = "rows between unbounded preceding and unbounded following"
    picks = F.array(*map(F.lit, weights))
    t = totals.withColumn("rank", F.expr(f"row_number() over (order by `{source}` asc nulls last)"))
    t = t.withColumn("weight", F.element_at(picks, (F.col("rank") - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = "order by fill, rank rows between unbounded preceding and 1 preceding"
    t = t.withColumn("before", F.expr(f"coalesce(sum(cap) over ({by_fill}), 0)")).withColumn("spent", F.expr(f"coalesce(sum(weight) over ({by_fill}), 0)"))
    t = t.withColumn("total", F.expr(f"sum(source_size) over (order by fill, rank {all_rows})") * share).withColumn("heavy", F.expr(f"sum(weight) over (order by fill, rank {all_rows})"))
    level = (F.col("total") - F.col("before")) / (F.col("heavy") - F.col("spent"))
    t = t.withColumn("level", level)  # of the first source, by fill, that stays below its cap, all after it have the level
    t = t.withColumn("open", F.when(F.col("level") <= F.col("fill"), F.col("level")))
    t = t.withColumn("level", F.expr(f"first_value(open, true) over (order by fill, rank {all_rows})"))
    t = t.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    return t.select(source, "source_size", "rank", "target", "epochs", "left", "n_docs", F.ceil(F.sqrt("n_docs")).cast("long").alias("buckets"))


def ranges(rows: DataFrame) -> DataFrame:
    """(of, levels): of each source how many rows have which weight, in steps of about a tenth; some 17 steps for weights of 1 to 4.

    They tell how the source's keys are spread: a share 1 - exp(-weight * key) of the rows of a weight is below a key.
    """
    steps = rows.groupBy(F.col("source").alias("of"), F.round(F.log2("weight") * 8).cast("int").alias("step")).agg(F.count("*").alias("n"))
    return steps.groupBy("of").agg(F.sort_array(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("step") / 8).alias("weight"), "n"))).alias("levels"))


def below(key: Column, levels: Column) -> Column:
    """The share of a source's rows with a lower key, from its levels; it grows with the key."""
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["n"] * (1 - F.exp(-x["weight"] * key)))


def keyed(docs: DataFrame, doc_id: str, text: str, source: str, weight: Column | None = None) -> dict[str, Column]:
    """id, _row_hash, source, size, weight and key of a row of docs, which its id, text and source alone decide."""
    w = quality(docs[text]) if weight is None else weight
    w = F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(1e-9)).cast("double")
    key = -F.log(uniform(docs[doc_id], docs[text])) / w
    return {"id": docs[doc_id], "_row_hash": F.xxhash64(docs[text]), "source": docs[source], "size": word_count(docs[text]), "weight": w, "key": key}


#: What documents of a source are ordered by, and the document at which its budget ends, as one value each.
ORDER, BORDER = "struct(key, id, _row_hash, size)", "struct(end_key as key, end_id as id, end_hash as _row_hash, end_size as size)"


def budgets(rows: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(of, source_size, target, epochs, left, end_key, end_id, end_hash, end_size, n, before) for each source of ``keyed`` rows.

    What epochs leave of the target goes to documents in order of their keys. The end_ columns tell the document at which it ends: those
    before it, of ``before`` words, are taken whole, those after it not at all. Rows repeated whole are n rows of one place. Null
    if nothing is left.

    No source is sorted in one task: keys fall into about sqrt(n) ranges of a source's n rows, evenly filled whatever the weights
    are. The ranges' sums, by partial aggregation, are summed up in order, and only the range in which a source's budget
    ends is sorted.
    """
    spread = scratch.keep(ranges(rows), "spread")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "source", weights, share, most)
    plan = plan.withColumn("left", F.round("left").cast("long")).join(spread, plan["source"].eqNullSafe(spread["of"])).drop("source")
    plan = scratch.keep(plan, "plan")
    bucket = F.floor(F.col("buckets") * below(F.col("key"), F.col("levels")) / F.col("n_docs"))
    placed = rows.join(plan.where("left > 0"), rows["source"].eqNullSafe(plan["of"])).select("rank", "left", bucket.alias("bucket"), "key", "id", "_row_hash", "size")
    sums = placed.groupBy("rank", "bucket", "left").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("ahead", F.expr("coalesce(sum(words) over (partition by rank order by bucket rows between unbounded preceding and 1 preceding), 0)"))
    at = scratch.keep(sums.where("ahead < left and ahead + words >= left").select("rank", "bucket", "ahead"), "at")
    inside = placed.join(at, ["rank", "bucket"]).groupBy("rank", "left", "ahead", "key", "id", "_row_hash", "size").agg(F.count("*").alias("n"))
    inside = inside.withColumn("before", F.col("ahead") + F.expr("coalesce(sum(size * n) over (partition by rank order by key, id, _row_hash, size rows between unbounded preceding and 1 preceding), 0)"))
    border = inside.where("before < left and before + size * n >= left").select("rank", F.col("key").alias("end_key"), F.col("id").alias("end_id"), F.col("_row_hash").alias("end_hash"), F.col("size").alias("end_size"), "n", "before")
    return scratch.keep(plan.join(border, "rank", "left").select("of", "source_size", "target", "epochs", "left", "end_key", "end_id", "end_hash", "end_size", "n", "before"), "budgets")


def pieces(rows: DataFrame, n: Column, by: str, copy: str = "copy") -> DataFrame:
    """Each row once for each number from 0 to n - 1, as ``copy``, in pieces that are dealt out to tasks; none for null."""
    piece = unused([*rows.columns, copy], "_piece")
    parts = rows.withColumn(copy, n.cast("long")).where(F.col(copy) > 0)
    parts = parts.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copy) - 1) / PIECE)))).repartition(F.col(by), F.col(piece))
    first = F.col(piece) * PIECE
    return parts.withColumn(copy, F.explode(F.sequence(first, F.least(first + PIECE, F.col(copy)) - 1))).drop(piece)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, weight: Column | None = None) -> DataFrame:
    """(id, _row_hash, source, size, source_size, target, epochs, taken) for every row; size is in words, null texts have none.

    Each source is taken whole as often as its target holds it; these are its epochs. What is left of the target is filled
    with documents in order of exponential keys -ln(u) / weight, u from id and text and weight positive, so better
    documents come sooner. The document at the border gives the words that still fit. taken counts the words with repeats. Rows
    repeated whole are documents of their own, taken one after the other; so are rows that share an id only, or have
    none. A very long text is one document like any other, and only its size is moved. A table without words has targets of
    0, an empty one an empty result; a missing source (null) is a source of its own. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(*(c.alias(n) for n, c in keyed(docs, doc_id, text, source, weight).items())), "rows")
    plan = budgets(rows, scratch, weights, share, most)
    told = rows.join(plan, rows["source"].eqNullSafe(plan["of"]))
    part = F.when(F.col("end_key").isNotNull() & (F.expr(ORDER) < F.expr(BORDER)), F.col("size")).otherwise(F.lit(0))
    columns = [F.col("id").alias(doc_id), "_row_hash", F.col("source").alias(source), "size", "source_size", "target", "epochs"]
    inner = told.where(F.col("end_key").isNull() | (F.expr(ORDER) != F.expr(BORDER))).select(*columns, (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    ends = pieces(plan.where("end_key is not null"), F.col("n"), "of").select(F.col("of").alias("source"), F.col("end_id").alias("id"), F.col("end_hash").alias("_row_hash"), F.col("end_size").alias("size"), "source_size", "target", "epochs", "left", "before", "copy")
    fits = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before") - F.col("copy") * F.col("size")))
    return inner.unionByName(ends.select(*columns, (F.col("epochs") * F.col("size") + fits).cast("long").alias("taken")))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, weight: Column | None = None) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken whole, with all their columns, whatever their names.

    As ``mix``, but the document at the border goes in if at least half of it fits. A document without words goes into each epoch. An
    empty table stays empty. Each row tells from its own id and text on which side of its source's border it is, so texts stay
    where they are read. Of rows repeated whole at a border one gives the copies that are taken in part.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(*(c.alias(n) for n, c in keyed(docs, doc_id, text, source, weight).items())), "rows")
    plan = budgets(rows, scratch, weights, share, most)
    room = (F.col("left") - F.col("before")) / F.col("end_size")  # copies of the document at the border that fit, with a part
    plan = scratch.keep(plan.select("of", "epochs", "end_key", "end_id", "end_hash", "end_size", F.least("n", F.floor(room + 0.5)).alias("last")), "taken")
    names = {c: unused(docs.columns, f"_{c}") for c in (*plan.columns, "copy")}
    few = plan.select(*(F.col(c).alias(names[c]) for c in plan.columns))
    mine, end = keyed(docs, doc_id, text, source, weight), {c: F.col(names[f"end_{c}"]) for c in ("key", "id", "hash", "size")}
    told = docs.join(few, docs[source].eqNullSafe(few[names["of"]]))
    order = F.struct(*(mine[c].alias(c) for c in ("key", "id", "_row_hash", "size")))
    border = F.struct(end["key"].alias("key"), end["id"].alias("id"), end["hash"].alias("_row_hash"), end["size"].alias("size"))
    times = F.col(names["epochs"]) + F.when(end["key"].isNotNull() & (mine["size"] > 0) & (order < border), 1).otherwise(0)
    whole = told.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    at_end = (F.col(names["last"]) > 0) & docs[doc_id].eqNullSafe(end["id"]) & mine["_row_hash"].eqNullSafe(end["hash"])
    ends = pieces(told.where(at_end).dropDuplicates([names["of"]]), F.col(names["last"]), names["of"], names["copy"])
    return whole.select(*docs.columns).unionByName(ends.select(*docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mix(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "size", "source_size", "target", "taken", "source")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+', ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*', 'w', 'g'))::BIGINT AS size,
                  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u,
                  CASE WHEN length(text) > 0 THEN 4 - 3 * least(1.0::DOUBLE, 10 * length(regexp_replace(text, '[^#*$%&|<>{}\[\]\\~^_=+@0-9]', '', 'g')) / length(text)::DOUBLE) ELSE 1.0::DOUBLE END AS w
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
t AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS fill FROM t),
m AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS before, coalesce(sum(weight) OVER b, 0) AS spent, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS heavy
      FROM l WINDOW b AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (total - before) / (heavy - spent)::DOUBLE AS level FROM m),
v AS (SELECT *, arg_min(level, (fill, rank)) FILTER (level <= fill) OVER () AS shared FROM o),
p AS (SELECT source, source_size, least(cap, coalesce(shared * weight, cap)) AS target FROM v),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
r AS (SELECT doc_id, d.source, size, source_size, target, epochs, round(target - epochs * source_size) AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, source FROM r
"""
