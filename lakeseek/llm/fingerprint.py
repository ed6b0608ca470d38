"""Document fingerprints: threshold-scaled sketches.

Every distinct word shingle has a 64-bit hash; those below ``2**64 * fraction`` are retained. A sketch so grows with its text,
sketches merge by union, and the share of one sketch inside another estimates containment without bias even where one text is a
thousand times the other. Nothing is shuffled to make sketches; merging and containment move retained hashes only.

Hashes are stored as signed longs. Defined cases: a text without words (null, empty, punctuation) has no shingle and an empty
sketch; a text of fewer words than a shingle is one shingle; a null id stays null; repeated rows have a sketch each; an empty table
gives an empty result; other columns are not looked at. A containment whose left sketch is empty is not estimated. A text of n shingles
retains none with a probability of ``(1 - fraction) ** n``: 0.002 for one of 50 words. Keys of ``containment`` are columns of any
names; rows with a null key are left out, and rows of one key are one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .tokens import BASE, MIX, STEP, U, distinct_by_row, lists, ngrams, pieces, text_buffer, tokens

SHINGLE = 5
FRACTION = 1 / 8
MINIMUM = 0.8
EVERY = 20


def sketch(docs: DataFrame, n: int = SHINGLE, fraction: float = FRACTION, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_shingles, sketch): the words, the distinct shingles and the retained hashes, ascending as signed numbers."""
    limit = U(min(int(fraction * 2**64), 2**64 - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            raw, off = text_buffer(b.column("text"))
            t, _, _, index = tokens(raw, off)
            h, _, row = ngrams(t, index, n)
            # the mixed hash is below the limit or not; its signed value orders the sketch
            kept = h < limit
            h_kept, row_kept = distinct_by_row(h[kept], row[kept])
            _, all_rows = distinct_by_row(h, row)
            yield pa.record_batch(
                [b.column(key), pa.array(np.diff(index).astype(np.int64)), pa.array(np.bincount(all_rows, minlength=b.num_rows).astype(np.int64)), lists(h_kept.view(np.int64), np.bincount(row_kept, minlength=b.num_rows), pa.int64())],
                [key, "n_words", "n_shingles", "sketch"],
            )

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, n_words long, n_shingles long, sketch array<long>")


def merge(sketches: DataFrame, by: str) -> DataFrame:
    """(by, sketch): the sketch of the union of each group's texts."""
    return sketches.select(by, F.explode("sketch").alias("h")).distinct().groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def estimate_shingles(sketch: Column, fraction: float = FRACTION) -> Column:
    return F.size(sketch) / F.lit(fraction)


def _classes(sketches: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, c) of every text with a sketch, and (c, sketch) of each distinct sketch, c a 128-bit name."""
    rows = sketches.select(F.col(key).cast("long").alias("id"), "sketch").where("id is not null and size(sketch) > 0")
    rows = rows.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("sketch"))
    named = rows.select("id", F.struct(F.xxhash64("sketch").alias("a"), F.xxhash64(F.lit(1), "sketch").alias("b")).alias("c"), "sketch")
    return named.select("id", "c"), named.groupBy("c").agg(F.first("sketch").alias("sketch"))


def _overlaps(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """(l, r, shared, containment) of the distinct sketches ``left`` and ``right`` (c, sketch) with at least this containment.

    A sketch of n hashes of which ceil(minimum * n) must be shared shares one of any n + 1 - ceil(minimum * n) of them. The rarest are
    taken, so that a passage of many texts makes pairs only where hardly anything else is in the sketch; nothing is missed.
    """
    each = right.select("c", F.explode("sketch").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"))
    mine = left.select("c", F.size("sketch").alias("n"), F.explode("sketch").alias("h")).join(often, "h")
    prefix = F.col("n") + 1 - F.greatest(F.lit(1), F.ceil(F.col("n") * minimum - 1e-9))
    rare = mine.withColumn("at", F.row_number().over(W.partitionBy("c").orderBy("often", "h"))).where(F.col("at") <= prefix)
    pair = rare.select(F.col("c").alias("l"), "h").join(each.withColumnRenamed("c", "r"), "h").select("l", "r").distinct()
    both = pair.join(left.select(F.col("c").alias("l"), F.col("sketch").alias("x")), "l").join(right.select(F.col("c").alias("r"), F.col("sketch").alias("y")), "r")
    shared = both.select("l", "r", F.size("x").alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("shared")).where("shared > 0")
    return shared.select("l", "r", "shared", (F.col("shared") / F.col("n")).alias("containment")).where(F.col("containment") >= minimum - 1e-9)


def containment(left: DataFrame, right: DataFrame, left_key: str, right_key: str, minimum: float = 0.0) -> DataFrame:
    """(left_key, right_key, shared, containment): the estimated share of the left text's shingles that the right text has.

    Every pair that shares a retained hash and reaches the minimum is there; with a minimum of 0 the number of pairs is that of the
    texts that share anything. Equal sketches are compared once. Where both keys have one name, the right one is called ``other``.
    """
    (a, x), (b, y) = _classes(left, left_key), _classes(right, right_key)
    found = _overlaps(x, y, minimum)
    out = found.join(a.select(F.col("id").alias("i"), F.col("c").alias("l")), "l").join(b.select(F.col("id").alias("j"), F.col("c").alias("r")), "r")
    return out.select(F.col("i").alias(left_key), F.col("j").alias(right_key if right_key != left_key else "other"), "shared", "containment")


def contained(sketches: DataFrame, key: str = "doc_id", minimum: float = MINIMUM, every: int = EVERY) -> DataFrame:
    """(key, n_containers, best_id, containment) of the texts whose id is divisible by ``every`` and that others hold to at least the minimum.

    n_containers: the other texts that do; best_id: the one that holds most of it, of equal ones that of the least id.
    """
    ids, sets = _classes(sketches, key)
    ids, sets = cut(ids), cut(sets)
    asking = ids.where(F.col("id") % every == 0)
    found = cut(_overlaps(sets.join(asking.select("c").distinct(), "c"), sets, minimum))
    # of each distinct sketch the number of texts and the two least ids, one of which is not the query's own
    size = ids.groupBy("c").agg(F.count("*").alias("many"), F.min("id").alias("first"))
    second = ids.join(size.select("c", "first"), "c").where("id <> first").groupBy("c").agg(F.min("id").alias("second"))
    size = size.join(second, "c", "left").select(F.col("c").alias("r"), "many", "first", "second")
    pair = asking.withColumnRenamed("c", "l").join(found, "l").join(size, "r")
    own = F.col("l") == F.col("r")
    other = F.when(own & (F.col("first") == F.col("id")), F.col("second")).otherwise(F.col("first"))
    pair = pair.select("id", "containment", (F.col("many") - own.cast("int")).alias("many"), other.alias("other")).where("many > 0")
    best = pair.groupBy("id").agg(F.sum("many").alias("n_containers"), F.min(F.struct(-F.col("containment"), "other")).alias("b"))
    return best.select(F.col("id").alias(key), "n_containers", F.col("b.other").alias("best_id"), F.round(-F.col("b.col1"), 9).alias("containment"))


_M = 1 << 64


def _sql() -> str:
    """DuckDB SQL of ``sketch``: the same hash in 128-bit integers. Products of two 64-bit numbers are split to fit."""
    def mul(a: str, c: int) -> str:
        lo, hi = c & 0xFFFFFFFF, c >> 32
        return f"((({a}) * {lo}::hugeint + (((({a}) & 4294967295::hugeint) * {hi}::hugeint) & 4294967295::hugeint) * 4294967296::hugeint) & {_M - 1}::hugeint)"

    steps = [pow(STEP, k, _M) for k in range(SHINGLE)]
    terms = " + ".join(f"coalesce({mul(f'w{k}', steps[k])}, 0::hugeint)" if k else mul("w0", steps[0]) for k in range(SHINGLE))
    leads = ", ".join(["m as w0", *[f"lead(m, {k}) over (partition by doc_id order by i) as w{k}" for k in range(1, SHINGLE)]])
    return f"""
with tok as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+') as ws from documents
), word as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from tok),
vocab as (select distinct w, hex(encode(w)) as x from word),
byte as (select w, j, ('0x' || substr(x, 2 * j + 1, 2))::hugeint + 1 as v from (select w, x, unnest(range(length(x) // 2)) as j from vocab)),
pw as (with recursive p(j, b) as (select 0::bigint, 1::hugeint union all select j + 1, {mul("b", BASE)} from p where j < (select max(j) from byte)) select * from p),
hash as (select w, sum(v * b)::hugeint & {_M - 1}::hugeint as h0 from byte join pw using (j) group by w),
h1 as (select w, xor(h0, h0 >> 32) as a from hash),
h2 as (select w, {mul("a", MIX)} as a from h1),
h3 as (select w, xor(a, a >> 29) as m from h2),
seq as (select doc_id, i, m from word join h3 using (w)),
lead_ as (select doc_id, i, {leads}, count(*) over (partition by doc_id) as n from seq),
sh as (select doc_id, n, ({terms}) & {_M - 1}::hugeint as s from lead_ where i + {SHINGLE - 1} <= n or (n < {SHINGLE} and i = 1)),
s1 as (select doc_id, xor(s, s >> 32) as a from sh),
s2 as (select doc_id, {mul("a", MIX)} as a from s1),
s3 as (select distinct doc_id, xor(a, a >> 29) as s from s2),
agg as (select doc_id, count(*) as n_shingles, list(case when s >= {1 << 63}::hugeint then s - {_M}::hugeint else s end order by s) filter (where s < {int(FRACTION * 2**64)}::hugeint) as sketch from s3 group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_shingles, 0)::bigint as n_shingles, coalesce(sketch, [])::bigint[] as sketch from tok d left join agg using (doc_id)
"""


ORACLE = _sql()


CONTAINED = f"""
with s as ({ORACLE}), u as (select doc_id, len(sketch) as n, unnest(sketch) as h from s),
p as (select a.doc_id, b.doc_id as other, count(*) / max(a.n) as c from u a join u b on a.h = b.h and a.doc_id <> b.doc_id where a.doc_id % {EVERY} = 0 group by 1, 2 having count(*) / max(a.n) >= {MINIMUM - 1e-9})
select doc_id, count(*)::bigint as n_containers, min_by(other, (-c, other))::bigint as best_id, round(max(c), 9) as containment from p group by doc_id
"""
