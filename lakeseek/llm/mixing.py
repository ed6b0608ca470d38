"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 48-bit hash of its id. Tokens are summed by source and leading hash bits; the running sum shows for every
source and budget the bucket in which the budget ends. Only the documents of that bucket are looked at again, by the next bits,
and those of the last boundary bucket one by one. A document is kept when its hash is within the threshold of its source: no
sort of the documents, and the samples of smaller budgets are nested in those of larger ones.

Target weights default to the sources' own shares with none above ``MAX_SHARE``, the excess spread over the others in
proportion. The whole mix is the largest that needs no repetition; budgets are fractions of it. Where the number of sources is
too small for the cap, equal shares are the target.

Defined cases: a null source is the source ''; a null or empty text has no tokens and is kept with any positive budget whose
threshold it does not pass; a null id hashes like the text 'null'; documents of one hash (repeated ids) are kept or dropped
together; a source without a target weight is dropped; an empty table gives an empty result; other columns pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, cut, fresh
from .tokens import SOLID, pieces, text_buffer, tokens

MAX_SHARE = 0.25
BUDGETS = (0.25, 0.5, 1.0)
BITS = 12
HASH = "cast(conv(substr(md5(coalesce(cast(doc_id as string), 'null')), 1, 12), 16, 10) as bigint)"


def count_tokens(column: pa.Array) -> np.ndarray:
    """White-space tokens of each text."""
    raw, off = text_buffer(column)
    if not len(raw):
        return np.zeros(len(column), np.int64)
    solid = SOLID[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    at = off[:-1][off[:-1] < len(raw)]
    start[at] = solid[at]
    total = np.concatenate([[0], np.cumsum(start)])
    return total[off[1:]] - total[off[:-1]]


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(count_tokens(b.column("text")))], ["doc_id", "source", "n_tokens"])


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, h), the only pass over the texts; checkpointed."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return cut(slim.mapInArrow(_slim, "doc_id long, source string, n_tokens long").withColumn("h", F.expr(HASH)))


def capped_shares(totals: DataFrame, max_share: float) -> DataFrame:
    """(source, tokens, weight): natural shares, none above the cap; (source, tokens) come in."""
    left = totals.where("tokens > 0").withColumn("capped", F.lit(False)).withColumn("n", F.count("*").over(W.partitionBy()))
    everything = W.partitionBy()
    for _ in range(int(1 / max_share) + 1):  # each round caps at least one source, and at most 1 / max_share fit
        free = F.sum(F.when(~F.col("capped"), F.col("tokens"))).over(everything)
        room = 1 - F.lit(max_share) * F.sum(F.col("capped").cast("int")).over(everything)
        left = left.withColumn("share", F.when(F.col("capped"), F.lit(max_share)).otherwise(F.col("tokens") * room / free)).withColumn("capped", F.col("share") >= max_share).drop("share")
    free = F.sum(F.when(~F.col("capped"), F.col("tokens"))).over(everything)
    room = 1 - F.lit(max_share) * F.sum(F.col("capped").cast("int")).over(everything)
    weight = F.when(F.col("n") * max_share <= 1, 1 / F.col("n")).when(F.col("capped"), F.lit(max_share)).otherwise(F.col("tokens") * room / free)
    return left.select("source", "tokens", weight.alias("weight"))


def budgets_of(slim: DataFrame, weights: dict[str, float] | None, max_share: float, budgets: Sequence[float]) -> DataFrame:
    """(source, budget, tokens): what each source may give to each nested budget, in whole tokens."""
    totals = slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if weights is None:
        target = capped_shares(totals, max_share)
    else:
        given = slim.sparkSession.createDataFrame(sorted(weights.items()), "source string, weight double")
        target = totals.join(given, "source").where("weight > 0 and tokens > 0")
    mix = F.min(F.col("tokens") / F.col("weight")).over(W.partitionBy())
    fractions = F.array(*[F.lit(float(b)) for b in sorted(budgets)])
    # a thousandth of a token makes up for rounding in the products
    return target.withColumn("mix", mix).select("source", F.explode(fractions).alias("budget"), "mix", "weight").select("source", "budget", F.floor(F.col("mix") * F.col("weight") * F.col("budget") + 0.001).alias("tokens"))


def thresholds(slim: DataFrame, limits: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, budget, last): the greatest hash that each budget takes of each source, -1 for none."""
    want = limits.select("source", "budget", F.col("tokens").alias("room"), F.lit(0).cast("long").alias("prefix"))
    shift = 48
    for _ in range(2):
        shift -= bits
        size = 1 << shift
        bucket = F.shiftright("h", shift)
        if shift == 48 - bits:
            rows = slim
        else:
            rows = slim.withColumn("_p", F.shiftright("h", shift + bits)).join(broadcast_if(want.select(F.col("source").alias("_s"), F.col("prefix").alias("_q")).distinct()), F.expr("source = _s and _p = _q"), "left_semi")
        hist = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("t")).withColumn("parent", F.shiftright("bucket", bits))
        running = hist.withColumn("upto", F.sum("t").over(W.partitionBy("source", "parent").orderBy("bucket")))
        # the first bucket that the room does not cover is the boundary
        got = want.alias("w").join(running.alias("r"), F.expr("w.source = r.source and w.prefix = r.parent and r.upto > w.room"), "left")
        want = (
            got.groupBy(F.col("w.source").alias("source"), "w.budget", "w.room", "w.prefix")
            .agg(F.min_by(F.struct("r.bucket", (F.col("r.upto") - F.col("r.t")).alias("before")), "r.bucket").alias("edge"))
            .select("source", "budget", F.expr("case when edge.bucket is null then room else room - edge.before end").alias("room"), F.coalesce("edge.bucket", F.lit(None).cast("long")).alias("prefix"), F.expr(f"case when edge.bucket is null then (w.prefix + 1) * {size << bits}L - 1 end").alias("whole"))
        )
        want = cut(want)
        done = want.where("prefix is null").select("source", "budget", F.col("whole").alias("last"))
        result = done if shift == 48 - bits else result.unionAll(done)  # noqa: F821
        want = want.where("prefix is not null").select("source", "budget", "room", "prefix")
    edge = broadcast_if(want)
    left = slim.withColumn("_p", F.shiftright("h", shift)).join(edge.withColumnRenamed("source", "_s"), F.expr("source = _s and _p = prefix"))
    by_hash = left.groupBy("source", "budget", "room", "prefix", "h").agg(F.sum("n_tokens").alias("t")).withColumn("upto", F.sum("t").over(W.partitionBy("source", "budget").orderBy("h")))
    some = by_hash.where("upto <= room").groupBy("source", "budget").agg(F.max("h").alias("inside"))
    rest = want.join(some, ["source", "budget"], "left").select("source", "budget", F.coalesce("inside", F.col("prefix") * F.lit(1 << shift) - 1).alias("last"))
    return result.unionAll(rest)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, max_share: float = MAX_SHARE, budgets: Sequence[float] = BUDGETS) -> DataFrame:
    """(doc_id, source, n_tokens, budget) of every document in the mix; budget is the smallest that holds it."""
    slim = token_table(docs)
    last = cut(thresholds(slim, cut(budgets_of(slim, weights, max_share, budgets))))
    per = last.groupBy(F.col("source").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("budget", "last"))).alias("steps"))
    first = F.expr("get(filter(steps, x -> h <= x.last), 0).budget")
    return slim.join(broadcast_if(per), F.col("source") == F.col("_s")).withColumn("budget", first).where("budget is not null").select("doc_id", "source", "n_tokens", "budget")


def keep(docs: DataFrame, weights: dict[str, float] | None = None, max_share: float = MAX_SHARE, fraction: float = 1.0) -> DataFrame:
    """``docs`` cut to the target mix; the test is on the hash of the id, so the texts are not moved."""
    slim = token_table(docs)
    source, limit = fresh(docs.columns, "_source"), fresh(docs.columns, "_last")
    last = cut(thresholds(slim, cut(budgets_of(slim, weights, max_share, (fraction,))))).select(F.col("source").alias(source), F.col("last").alias(limit))
    inside = docs.join(broadcast_if(last), F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(source)).where(F.expr(HASH) <= F.col(limit))
    return inside.select(*docs.columns)


ORACLE = f"""
with d as (
  select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\x0b\\f\\r ]+')) as n_tokens,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 12))::bigint as h
  from documents
), t as (select source, sum(n_tokens)::double as tokens from d group by 1 having sum(n_tokens) > 0),
c1 as (select *, tokens / (sum(tokens) over ()) >= {MAX_SHARE} as capped, count(*) over () as n from t),
c2 as (select * replace (capped or tokens * (1 - {MAX_SHARE} * sum(capped::int) over ()) / (sum(case when not capped then tokens end) over ()) >= {MAX_SHARE} as capped) from c1),
c3 as (select * replace (capped or tokens * (1 - {MAX_SHARE} * sum(capped::int) over ()) / (sum(case when not capped then tokens end) over ()) >= {MAX_SHARE} as capped) from c2),
w as (select source, tokens, case when n * {MAX_SHARE} <= 1 then 1 / n when capped then {MAX_SHARE}
    else tokens * (1 - {MAX_SHARE} * sum(capped::int) over ()) / (sum(case when not capped then tokens end) over ()) end as weight from c3),
m as (select source, weight, min(tokens / weight) over () as mix from w),
l as (select source, b.budget, floor(mix * weight * b.budget + 0.001) as room from m, (values (0.25::double), (0.5::double), (1.0::double)) b(budget)),
r as (select *, sum(n_tokens) over (partition by source order by h range between unbounded preceding and current row) as upto from d)
select r.doc_id, r.source, r.n_tokens::bigint as n_tokens, min(l.budget) as budget from r join l on r.source = l.source and r.upto <= l.room group by all
"""
