"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import ids, text
from ..operators import code, datum, graph, meta, result, split, vector
from ..sources import files
from . import cypher, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer partitions than there are, as one small file does; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- vectors: the query vector is that of the least id, or of the least id of each label

_Q = "q as (select embedding as e from embeddings where vec_id = 0)"
_COS = "round(list_cosine_similarity(embedding::double[], e::double[]), 6)"


def _vectors(spark: SparkSession, sf: str, n: int = 1) -> tuple[DataFrame, list]:
    v = table(spark, sf, "embeddings")
    first = [r["embedding"] for r in v.where(F.col("vec_id") < n).orderBy("vec_id").select("embedding").collect()]  # n query vectors
    return v, first


@query(f"with {_Q} select vec_id, {_COS} as score from embeddings, q order by score desc, vec_id limit 10")
def vector_topk(spark, sf):
    v, q = _vectors(spark, sf)
    return vector.top_k(v, q[0])


@query(f"with {_Q} select vec_id, {_COS} as score from embeddings, q where label = 3 order by score desc, vec_id limit 10")
def vector_topk_filtered(spark, sf):
    v, q = _vectors(spark, sf)
    return vector.top_k(v, q[0], exact={"label": 3})


@query(f"""with q as (select label::bigint as query_id, min_by(embedding, vec_id) as e from embeddings group by label),
s as (select query_id, vec_id, {_COS} as score from embeddings, q)
select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s qualify rank <= 10""")
def vector_topk_batch(spark, sf):
    v = table(spark, sf, "embeddings")
    queries = v.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return vector.batch_top_k(queries, v)


@query(f"""with h as (select vec_id // 3 as chunk_id, {_COS} as score from embeddings, (select embedding as e from embeddings where vec_id = 0))
select chunk_id, max(score) as score from h group by chunk_id""")
def dim_fold(spark, sf):
    v, q = _vectors(spark, sf)
    score = F.round(vector.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q[0]])), 6)
    return vector.fold_dimensions(v.select(F.expr("vec_id div 3").alias("chunk_id"), score.alias("score")))


@query("""with h as (select conv_id * 1000 + turn as chunk_id, case when turn > 0 then conv_id * 1000 end as parent_id, round(length(text) / 100.0, 6)::double as score from conversations),
f as (select case when p.chunk_id is not null then h.parent_id else h.chunk_id end as chunk_id, h.score from h left join (select distinct chunk_id from h) p on h.parent_id = p.chunk_id)
select chunk_id, max(score) as score from f group by 1""")
def parent_fold(spark, sf):
    c = table(spark, sf, "conversations")
    hits = c.selectExpr("conv_id * 1000 + turn as chunk_id", "case when turn > 0 then conv_id * 1000 end as parent_id", "round(char_length(text) / 100D, 6) as score")
    return vector.fold_parents(hits.groupBy("chunk_id", "parent_id").agg(F.max("score").alias("score")))


@query("select vec_id, label from embeddings where label = 2")
def list_exact(spark, sf):
    return vector.where(table(spark, sf, "embeddings"), exact={"label": 2}).select("vec_id", "label")


@query("select doc_id, source from documents where source like 'src1%'")
def list_prefix(spark, sf):
    return vector.where(table(spark, sf, "documents"), prefix={"source": "src1"}).select("doc_id", "source")


@query("select doc_id, source, n_chars from documents order by n_chars desc, doc_id limit 20 offset 20")
def list_page(spark, sf):
    return vector.page(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 2)


@query("select count(*)::bigint as vectors, count_if(label % 2 = 0)::bigint as main from embeddings")
def count_main(spark, sf):
    v = table(spark, sf, "embeddings").select(F.when(F.col("label") % 2 == 0, "content").otherwise("title").alias("dim"))
    return vector.count_main(v)


@query("""select vec_id, case when vec_id % 2 = 0 then list_reverse(embedding) else embedding end::double[] as embedding, case when vec_id % 2 = 0 then label + 100 else label end::int as label from embeddings
union all select vec_id + 1000000, embedding::double[], -1 from embeddings where vec_id % 50 = 0""")
def vector_upsert(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    new = v.where("vec_id % 2 = 0").select("vec_id", F.reverse("embedding").alias("embedding"), (F.col("label") + 100).alias("label"))
    return vector.upsert(v, new.unionByName(v.where("vec_id % 50 = 0").selectExpr("vec_id + 1000000 as vec_id", "embedding", "-1 as label")), ["vec_id"])


@query("select vec_id, embedding::double[] as embedding, label from embeddings where vec_id not in (select doc_id from labels where toxic = 1)")
def vector_delete(spark, sf):
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return vector.delete(table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), gone, "vec_id")


@query("""with c as (select conv_id, turn, min(text) as content, min(role) as title from conversations group by 1, 2)
select conv_id * 1000 + turn as chunk_id, dim, length(t)::int as n from (select conv_id, turn, 'content' as dim, content as t from c union all select conv_id, turn, 'title', title from c) where trim(coalesce(t, '')) <> ''""")
def index_rows(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("content"), F.min("role").alias("title")).withColumn("chunk_id", F.expr("conv_id * 1000 + turn"))
    have = vector.index_rows(c.where("turn = 0").drop("title"), F.length)
    return vector.refill(have, c, F.length).withColumnRenamed("vector", "n")


@query("""select doc_id, case when quality = 1 then lang else 'low' end as lang, source from (select d.doc_id, d.lang, d.source, l.quality from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)) where quality is not null
union all select doc_id, lang, source from documents where doc_id not in (select doc_id from labels where doc_id is not null and quality is not null)""")
def metadata_patch(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    known = table(spark, sf, "labels").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    known = known.join(d.select("doc_id"), "doc_id", "left_semi")
    patch = known.select("doc_id", F.when(F.col("q") == 1, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("lang"), F.lit("low"))).alias("patch"))
    return vector.patch_metadata(d, patch, "doc_id").select("doc_id", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


# ---- result algebra

_TWO = f"""q as (select max(case when vec_id = 0 then embedding end) as e0, max(case when vec_id = 1 then embedding end) as e1 from embeddings where vec_id < 2),
a as (select vec_id, row_number() over (order by score desc, vec_id) as r from (select vec_id, {_COS.replace('e::', 'e0::')} as score from embeddings, q order by score desc, vec_id limit 50)),
b as (select vec_id, row_number() over (order by score desc, vec_id) as r from (select vec_id, {_COS.replace('e::', 'e1::')} as score from embeddings, q order by score desc, vec_id limit 50))"""


def _fused(spark, sf, one: float, two: float) -> DataFrame:
    v, q = _vectors(spark, sf, 2)
    return result.rrf([(vector.top_k(v, q[0], 50), one), (vector.top_k(v, q[1], 50), two)], "vec_id")


@query(f"with {_TWO} select vec_id, round(sum(s), 9) as score from (select vec_id, 1 / (60.0::double + r) as s from a union all select vec_id, 1 / (60.0::double + r) from b) group by 1")
def rrf_fusion(spark, sf):
    return _fused(spark, sf, 1.0, 0.0)


@query(f"with {_TWO} select vec_id, round(sum(s), 9) as score from (select vec_id, 1 / (60.0::double + r) as s from a union all select vec_id, 0.7::double / (60 + r) from b) group by 1")
def rrf_weighted(spark, sf):
    return _fused(spark, sf, 1.0, 0.7)


@query("""with b as (select doc_id, 1.0::double / (1 + n_chars) as s, coalesce(text, '') as t, lang, source from documents)
select doc_id, round(s * (1 + least(1.0::double, 0.15::double * least(3, contains(lower(t), 'the')::int + contains(lower(t), 'report')::int + (contains(lower(t), 'en') or lang = 'en')::int + (contains(lower(t), 'src3') or lower(source) = 'src3')::int))), 9) as score from b""")
def keyword_boost(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.lit(1.0) / (1 + F.col("n_chars"))).alias("s"), F.coalesce("text", F.lit("")).alias("t"), "lang", "source")
    return d.select("doc_id", F.round(result.boost(F.col("s"), ["the", "report", "en", "src3"], split.first_line(F.col("t")), F.col("t"), F.array("lang", "source")), 9).alias("score"))


@query(f"""with q as (select label::bigint as query_id, min_by(embedding, vec_id) as e from embeddings group by label),
s as (select query_id, vec_id, {_COS} as score from embeddings, q),
a as (select query_id, vec_id, row_number() over (partition by query_id order by score desc, vec_id) as r from s),
b as (select label::bigint as query_id, vec_id, row_number() over (partition by label order by vec_id desc) as r from embeddings)
select query_id, vec_id, round(sum(x), 9) as score from (select query_id, vec_id, 1 / (60.0::double + r) as x from a where r <= 10 union all select query_id, vec_id, 0.7::double / (60 + r) from b) group by 1, 2""")
def rrf_by_query(spark, sf):
    v = table(spark, sf, "embeddings")
    queries = v.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    one = vector.batch_top_k(queries, v)
    two = v.select(F.col("label").cast("long").alias("query_id"), "vec_id", F.col("vec_id").cast("double").alias("score"))
    return result.rrf([(one, 1.0), (None, 1.0), (two, 0.7)], "vec_id", by=["query_id"])


@query("select conv_id, round(sum(m), 6) as score from (select conv_id, role, max(length(text) / 1000.0::double) as m from conversations group by 1, 2) group by 1")
def hit_score(spark, sf):
    hits = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("collection"), (F.char_length("text") / 1000.0).alias("score"))
    return result.hit_score(hits, ["conv_id"]).select("conv_id", F.round("score", 6).alias("score"))


@query(f"""with q as (select max(case when vec_id = 0 then embedding end) as e0, max(case when vec_id = 1 then embedding end) as e from embeddings where vec_id < 2),
h as (select vec_id from embeddings, q order by {_COS.replace('e::', 'e0::')} desc, vec_id limit 30)
select vec_id, {_COS} as score from embeddings join h using (vec_id), q""")
def rerank_cosine(spark, sf):
    v, q = _vectors(spark, sf, 2)
    return vector.rerank(vector.top_k(v, q[0], 30), v, q[1])


@query()
def minhash_dedup(spark, sf):
    d = spread(table(spark, sf, "documents")).selectExpr("doc_id", "source", "coalesce(text, '') as text", "cast(n_chars as double) as score")
    return result.minhash_dedup(d, "source", "doc_id").select("doc_id", "source", "score")


# ---- text

_T = "coalesce(text, '')"


def _documents(spark, sf, name: str, f) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", f(F.coalesce("text", F.lit(""))).alias(name))


def _noise_sql(c: str) -> str:
    for name, sign in text.ENTITIES:
        c = f"replace({c}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    c = f"regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    for s in text.SPACES:
        c = f"replace({c}, chr({ord(s)}), ' ')" if ord(s) != 32 else c
    for s in text.ZERO_WIDTH:
        c = f"replace({c}, chr({ord(s)}), '')"
    return f"trim(regexp_replace({c}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


_MASKS = (
    (rf"\b{text.ID_CARD}\b", "310***********1234"),
    (r"\b1[3-9][0-9]{9}\b", "138****1234"),
    (rf"\b{text.BANK_CARD}\b", "6222****1234"),
    (r"\b(sk-|pk-)([A-Za-z0-9]{16})([A-Za-z0-9]{17})\b", r"\1\2' || chr(1) || '\3"),  # kept: parted for the next step
    (r"\b(?:sk-|pk-|api_)?[A-Za-z0-9]{32,}\b", "sk-****xxxx"),
    (r"\b([0-9A-Za-z_.+-]+)@([0-9A-Za-z_.-]+\.[a-zA-Z]{2,})\b", r"a***@\2"),
)


def _mask_sql(c: str) -> str:
    for pattern, new in _MASKS:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return f"replace({c}, chr(1), '')"


@query(f"select doc_id, {_noise_sql(_T)} as text from documents")
def clean_noise(spark, sf):
    return _documents(spark, sf, "text", text.clean_noise)


@query(f"select doc_id, {_mask_sql(_T)} as text from documents")
def desensitize_pii(spark, sf):
    return _documents(spark, sf, "text", text.desensitize)


def _half_sql(c: str) -> str:
    wide, narrow = text.WIDE + "　“”‘’", text.NARROW + " \"\"''"
    return f"translate({c}, '{wide.replace(chr(39), chr(39) * 2)}', '{narrow.replace(chr(39), chr(39) * 2)}')"


def _watermark_sql(c: str) -> str:
    for w in text.WATERMARKS:
        c = f"replace({c}, '{w}', '')"
    for w in text.WATERMARK_WORDS:
        c = f"regexp_replace({c}, '(?i){w}', '', 'g')"
    return c


def _simplified_sql(c: str) -> str:
    for old, new in text.WORDS:
        c = f"replace({c}, '{old}', '{new}')"
    return f"translate({c}, '{text.TRADITIONAL}', '{text.SIMPLIFIED}')"


def _basic_sql(c: str) -> str:
    return f"""trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\t\\n\\f\\r .,;!?:''"()。，、！？；：（）]', ' ', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'))"""


@query(f"select doc_id, {_half_sql(_T)} as text from documents")
def half_width(spark, sf):
    return _documents(spark, sf, "text", text.half_width)


_MARKED = f"{_T} || ' Internal 機密 資料處理 ' || source || ' 网络 系統設計 許 軟體 copyright 版权所有'"


@query(f"select doc_id, {_simplified_sql(_MARKED)} as text from documents")
def simplified_script(spark, sf):
    return _marked(spark, sf, text.simplified)


def _marked(spark, sf, f) -> DataFrame:
    """Whole texts with some words that the step is for."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", f(F.concat(F.coalesce("text", F.lit("")), F.lit(" Internal 機密 資料處理 "), "source", F.lit(" 网络 系統設計 許 軟體 copyright 版权所有"))).alias("text"))


@query(f"select doc_id, {_watermark_sql(_MARKED)} as text from documents")
def remove_watermarks(spark, sf):
    return _marked(spark, sf, text.remove_watermarks)


@query(f"select doc_id, {_basic_sql(_T)} as text from documents")
def clean_basic(spark, sf):
    return _documents(spark, sf, "text", text.clean)


_LINK = "https?://[^\\s<>\"{}|\\\\^`\\[\\]]+"


@query(f"""select page_id, regexp_replace(regexp_replace(regexp_replace('![i](x.png) [' || url || '](' || url || ') see ' || url || ' end', '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '{_LINK}', '', 'g') as text from pages""")
def remove_links(spark, sf):
    made = F.concat(F.lit("![i](x.png) ["), "url", F.lit("]("), "url", F.lit(") see "), "url", F.lit(" end"))
    return table(spark, sf, "pages").select("page_id", text.remove_links(made).alias("text"))


@query(f"select doc_id, regexp_replace(regexp_replace(regexp_replace({_T}, '\\r\\n?', chr(10), 'g'), '(?m)^\\t+', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as text from documents")
def normalize_paragraphs(spark, sf):
    return _documents(spark, sf, "text", text.normalize_paragraphs)


def _paragraph_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '(?m)^\\t+', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _link_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '{_LINK}', '', 'g')"


_STEPS = [("a", _half_sql), ("b", _noise_sql), ("c", _link_sql), ("d", lambda c: f"regexp_replace({c}, '(?m)^\\s*[0-9]+[.)]\\s+', '', 'g')"), ("e", _watermark_sql), ("f", _simplified_sql), ("g", _mask_sql), ("h", _paragraph_sql), ("i", _basic_sql)]
_CLEAN = f"with z as (select doc_id, {_T} as t from documents)" + "".join(f", {n} as (select doc_id, {f('t')} as t from {'zabcdefgh'[k]})" for k, (n, f) in enumerate(_STEPS)) + " select doc_id, t as text from i"


@query(_CLEAN)
def clean_text(spark, sf):
    return _documents(spark, sf, "text", text.clean_text)


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""with w as (select doc_id, unnest(regexp_split_to_array(lower({_T}), '[^0-9a-z\\x{{80}}-\\x{{10ffff}}]+')) as w from documents)
select doc_id, count(distinct w)::bigint as n, min(w) as first, max(w) as last from w where length(w) > 1 and w not in ({_STOP}) group by doc_id""")
def keywords(spark, sf):
    words = _documents(spark, sf, "w", text.keywords).where(F.size("w") > 0)
    return words.select("doc_id", F.size("w").cast("long").alias("n"), F.array_min("w").alias("first"), F.array_max("w").alias("last"))


@query("select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as text from pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(text.strip_tags(F.col("html")), "\\s+", " ")).alias("text"))


@query("select page_id, trim(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&')) as title from pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.title_of(F.col("html")).alias("title"))


@query()
def page_markdown(spark, sf):
    to_md = F.udf(files.html_to_markdown, "string", useArrow=False)  # 100 pages at once, not 10,000
    return table(spark, sf, "pages").select("page_id", to_md("html").alias("markdown"))


# ---- identity

@query(f"""select doc_id, sha256({_T}) as full_hash, case when {_T} = '' then '' else left(sha256(text), 16) end as content_hash,
sha256(lower(source)) as region_id, sha256(doc_id || ':' || source || ':' || {_T}) as chunk_id from documents""")
def identity_hashes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", ids.doc_id(F.lit(""), F.col("text")).alias("full_hash"), ids.content_hash(F.col("text")).alias("content_hash"), ids.region_id(F.col("source")).alias("region_id"), ids.digest(F.col("doc_id"), F.col("source"), F.col("text")).alias("chunk_id"))


# ---- splitters; pages give the headings: title as level 1, each table row of the site as level 2 or 3

_MD = """m as (select page_id, '# ' || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || chr(10) || 'intro ' || trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) || chr(10) || '## ' || url || chr(10) || 'body' || chr(10) || case when page_id % 2 = 0 then '### deep' || chr(10) || 'x' || chr(10) else '' end || '## last' || chr(10) || chr(10) as md from pages)"""
_SECTIONS = f"""{_MD}, l as (select page_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as pos from m),
v as (select *, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \\t]', 1)) as lv from l),
i as (select *, sum((lv > 0)::int) over (partition by page_id order by pos) as ix from v),
s as (select page_id, ix::bigint as index, max(lv)::int as level, min_by(line, pos) as head, rtrim(string_agg(line, chr(10) order by pos), chr(10)) as content from i group by 1, 2)"""


def _made_markdown(spark, sf) -> DataFrame:
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    nl = F.lit("\n")
    deep = F.when(F.col("page_id") % 2 == 0, "### deep\nx\n").otherwise("")
    md = F.concat(F.lit("# "), title, nl, F.lit("intro "), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "\\s+", " ")), nl, F.lit("## "), "url", nl, F.lit("body\n"), deep, F.lit("## last\n\n"))
    return spread(table(spark, sf, "pages")).select("page_id", md.alias("md"))


@query(f"with {_SECTIONS} select page_id, index, level, regexp_replace(head, '^ {{0,3}}#{{1,6}}[ \\t]+|[ \\t]+#*[ \\t]*$', '', 'g') as title, content from s where level > 0")
def md_split(spark, sf):
    return split.markdown(_made_markdown(spark, sf), "page_id", "md").drop("parent")


@query(f"with {_SECTIONS} select a.page_id, a.index, max(b.index) as parent from s a left join s b on a.page_id = b.page_id and b.index < a.index and b.level < a.level and b.level > 0 group by 1, 2")
def md_parent(spark, sf):
    return split.markdown(_made_markdown(spark, sf), "page_id", "md").select("page_id", "index", "parent")


@query()
def line_split(spark, sf):
    return split.lines(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""select doc_id, case when regexp_matches({_T}, '{split._CODE_WORDS.replace(chr(92) * 2, chr(92))}') then 'code' when strlen({_T}) < 200 then 'sentence' when strlen({_T}) > 2000 then 'parent_doc'
when len(list_filter(string_split({_T}, chr(10)), lambda x: regexp_matches(trim(x), '^(?:#|[-*>] |1\\. |```)'))) >= 3 then 'paragraph' else 'recursive' end as strategy from documents""")
def strategy_label(spark, sf):
    return _documents(spark, sf, "strategy", split.strategy)


_MARK = "regexp_matches(x, '^(?:#|[-*] |[12]\\. |> |---|===|\\*|```)')"
_WORD = lambda c, words: f"regexp_matches({c}, '^(?:{words})')"


@query(f"""with c as (select page_id::varchar as id, html as x from pages union all select 'e' || event_id, props from events union all select 'b' || item_id, text from benchmark union all select 'd' || doc_id, text from documents where text is not null
 union all select 'p' || p_partkey, case p_partkey % 12 when 0 then 'select ' || p_name when 1 then 'k = ' || p_partkey when 2 then '# ' || p_name when 3 then 'type ' || p_name || ' {{' when 4 then 'def f():' when 5 then 'package a' || chr(10) || 'func b' when 6 then '---' || chr(10) || 'a: 1' when 7 then 'const a => 1' when 8 then 'a {{ b: c; }}' when 9 then '* item' when 10 then '$a' else 'fun main' end from part),
t as (select id, regexp_replace(x, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') as t from c),
r as (select *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') as rows from t),
l as (select *, list_filter(rows, lambda x: {_MARK} or strlen(x) > 3)[1] as x, coalesce(list_filter(rows, lambda x: not starts_with(x, '//') and not starts_with(x, '#'))[1], '') as line from r)
select id, case when t = '' then 'text/plain' when (starts_with(t, '{{') and ends_with(t, '}}')) or (starts_with(t, '[') and ends_with(t, ']')) then 'application/json'
when {_WORD('t', '<[?]|<!|<html|<head|<body|<div|<p>|<span')} then 'text/html' when starts_with(t, '---') then 'text/yaml'
when (starts_with(t, '[') or (contains(t, '=') and not contains(t, ':'))) and len(list_filter(rows, lambda x: not (starts_with(x, '#') or (starts_with(x, '[') and ends_with(x, ']')) or contains(x, '=')))) = 0 then 'text/toml'
when coalesce({_MARK}, false) then 'text/markdown'
when starts_with(t, '{{') or len(list_filter(rows, lambda x: not starts_with(x, '/*') and (contains(x, '{{') or contains(x, '}}') or (contains(x, ':') and contains(x, ';'))))) > 0 then 'text/css'
when len(list_filter(rows, lambda x: {_WORD('x', 'type |query |mutation |subscription |fragment |schema |extend |enum |interface |union |input |scalar |directive ')})) > 0 then 'application/graphql'
when {_WORD('upper(t)', 'SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TABLE|INDEX|VIEW|FROM|WHERE|JOIN|LEFT|RIGHT|INNER|OUTER|GROUP BY|ORDER BY|HAVING|LIMIT|OFFSET')} then 'text/sql'
when {_WORD('line', 'package |import ')} and contains(t, 'func ') then 'text/x-go' when {_WORD('line', 'def |class |import |from ')} then 'text/x-python' when {_WORD('line', 'public class|private |protected ')} then 'text/x-java'
when {_WORD('line', 'int main[(]|void main[(]')} then 'text/x-c' when {_WORD('line', 'fn main[(]|use |let mut |impl ')} then 'text/x-rust'
when {_WORD('line', 'const |let |var |function ')} or contains(line, '=>') then case when contains(line, ': ') and (contains(line, 'interface') or contains(line, 'type ')) then 'text/typescript' else 'text/javascript' end
when {_WORD('line', 'module ')} then 'text/x-ruby' when {_WORD('line', '[$]')} then 'text/x-php' when {_WORD('line', 'func ')} then 'text/x-swift' when {_WORD('line', 'fun |val |data class')} then 'text/x-kotlin' else 'text/plain' end as mime from l""")
def mime_sniff(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("cast(page_id as string) as id", "html as t").unionAll(table(spark, sf, "events").selectExpr("concat('e', event_id)", "props")).unionAll(table(spark, sf, "benchmark").selectExpr("concat('b', item_id)", "text"))
    rows = rows.unionAll(table(spark, sf, "documents").where("text is not null").selectExpr("concat('d', doc_id)", "text"))
    made = ["'select ' || p_name", "'k = ' || p_partkey", "'# ' || p_name", "'type ' || p_name || ' {'", "'def f():'", "'package a\\nfunc b'", "'---\\na: 1'", "'const a => 1'", "'a { b: c; }'", "'* item'", "'$a'"]
    cases = " ".join(f"when {k} then {m}" for k, m in enumerate(made))
    rows = rows.unionAll(table(spark, sf, "part").selectExpr("concat('p', p_partkey)", f"case p_partkey % 12 {cases} else 'fun main' end"))
    return rows.select("id", split.stripped(F.col("t")).alias("t")).select("id", split.mime_of_stripped(F.col("t")).alias("mime"))  # stripped once, not by each rule


_NAMES = "select p_partkey, '/Dir' || p_size || '/sub/' || replace(p_name, ' ', '_') || '.' || case p_partkey % 8 when 0 then 'MD' when 1 then 'py' when 2 then 'csv' when 3 then 'JPG' when 4 then 'tar.gz' when 5 then 'ts' when 6 then 'docx' else 'log' end as path from part"


def _paths(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey", "concat('/Dir', p_size, '/sub/', replace(p_name, ' ', '_'), '.', case p_partkey % 8 when 0 then 'MD' when 1 then 'py' when 2 then 'csv' when 3 then 'JPG' when 4 then 'tar.gz' when 5 then 'ts' when 6 then 'docx' else 'log' end) as path")


@query(f"""select p_partkey, case p_partkey % 8 when 3 then 'image' when 1 then 'code' when 5 then 'code' when 2 then 'datum' when 7 then 'datum' else 'markdown' end as route,
case p_partkey % 8 when 0 then 'text/markdown' when 1 then 'text/x-python' when 2 then 'text/csv' when 3 then 'image/jpeg' when 5 then 'text/typescript' when 6 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' end as mime,
case p_partkey % 8 when 3 then 'Image' when 1 then 'Code' when 5 then 'Code' when 2 then 'DataFile' when 7 then 'DataFile' else 'Document' end as content_type from ({_NAMES})""")
def router_label(spark, sf):
    way = split.route(F.col("path"))
    return _paths(spark, sf).select("p_partkey", way.alias("route"), split.mime_of_name(F.col("path")).alias("mime"), split.content_type(way).alias("content_type"))


@query(f"""select p_partkey, lower(regexp_extract(path, '[.]([^./]+)$', 1)) as ext, regexp_extract(path, '([^/]*)$', 1) as file_name, lower(regexp_replace(path, '/[^/]*$', '')) as folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', '') as stem from ({_NAMES})""")
def path_parts(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("p_partkey", text.extension(p).alias("ext"), text.file_name(p).alias("file_name"), text.folder(p).alias("folder"), text.stem(p).alias("stem"))


@query("""select event_id, (props::json->>'k')::bigint as k, event_type from events""")
def repair_json(spark, sf):
    k = F.get_json_object("props", "$.k")
    answer = F.concat(F.lit("```json\n[{“k”："), k, F.lit('}{"e":"'), F.col("event_type"), F.lit('"},]```'))
    fixed = text.repair_json(answer)
    return table(spark, sf, "events").select("event_id", F.get_json_object(fixed, "$[0].k").cast("long").alias("k"), F.get_json_object(fixed, "$[1].e").alias("event_type"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, epoch_us(o_orderdate)::bigint as micros from orders")
def dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    mail = F.concat(F.date_format("t", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    ticks = (F.unix_micros("t") + F.lit(11_644_473_600_000_000)) * 10
    return o.select("o_orderkey", text.mail_date(mail).alias("iso"), F.unix_micros(text.filetime(ticks)).alias("micros"))


@query(f"with l as (select doc_id, unnest(string_split({_T}, chr(10))) as t, generate_subscripts(string_split({_T}, chr(10)), 1) as line from documents) select doc_id, line::int as line, rtrim(t, chr(13)) as text from l where trim(t) <> ''")
def log_lines(spark, sf):
    return split.log_entries(table(spark, sf, "documents"), "doc_id", "text")


@query(f"with {_SECTIONS}, h as (select * from s where level > 0), p as (select a.page_id, a.index, max(b.index) as parent from h a left join h b on a.page_id = b.page_id and b.index < a.index and b.level < a.level group by 1, 2) select page_id, count(*)::bigint as edges, count(parent)::bigint as inner_edges from p group by 1")
def section_graph(spark, sf):
    parts = split.markdown(_made_markdown(spark, sf), "page_id", "md")
    nodes, edges = split.section_graph(parts, "page_id")
    roots = nodes.where(F.array_contains("labels", "Document")).select(F.col("node_id").alias("src"), F.lit(1).alias("root"))
    ids_ = parts.select("page_id", ids.digest(F.col("page_id"), F.col("index"), F.lit("Section")).alias("dst"))
    each = edges.join(ids_, "dst").join(roots, "src", "left")
    return each.groupBy("page_id").agg(F.count("*").alias("edges"), F.count_if(F.col("root").isNull()).alias("inner_edges"))


# ---- data files: a JSON text for each nation, with its customers

_JSON = """j as (select n_nationkey::varchar as doc_id, '{"nation":{"key":' || n_nationkey || ',"name":"' || n_name || '"},"customers":[' as head, list('{"id":' || c_custkey || ',"seg":"' || c_mktsegment || '"}' order by c_custkey) as cs from nation join customer on c_nationkey = n_nationkey group by n_nationkey, n_name),
w as (select *, '[' || array_to_string(cs, ',') || ']' as arr from j)"""


def _json_files(spark, sf) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = F.struct("c_custkey", F.concat(F.lit('{"id":'), "c_custkey", F.lit(',"seg":"'), "c_mktsegment", F.lit('"}')).alias("t"))
    by = rows.groupBy("n_nationkey", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ",").alias("cs"), F.count("*").alias("n"))
    body = F.concat(F.lit('{"nation":{"key":'), "n_nationkey", F.lit(',"name":"'), "n_name", F.lit('"},"customers":['), "cs", F.lit('],"count":'), "n", F.lit("}"))
    return by.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("/data/n"), "n_nationkey", F.lit(".json")).alias("file_name"), body.alias("content"))


_DATUM = f"""with {_JSON}, c as (select doc_id, 'JSON.nation' as title, regexp_extract(head, '^[{{]"nation":(.*),"customers":.$', 1) as content from w
union all select doc_id, 'JSON.customers', arr from w where strlen(arr) <= {datum.LIMIT}
union all select doc_id, 'JSON.customers[' || (i - 1) || ']', cs[i] from (select doc_id, cs, unnest(range(1, len(cs) + 1)) as i, arr from w) where strlen(arr) > {datum.LIMIT}
union all select doc_id, 'JSON.{datum.REST}', '"count":' || len(cs) from w)"""


@query(f"{_DATUM} select doc_id, title, content, sha256(doc_id || ':' || title || ':' || content) as chunk_id from c")
def datum_split(spark, sf):
    return datum.split(_json_files(spark, sf)).select("doc_id", "title", "content", "chunk_id")


@query(f"{_DATUM} select c.doc_id, c.title, case when starts_with(c.title, 'JSON.customers[') then 'JSON.customers' when not starts_with(c.title, 'JSON.{datum.REST}') then 'JSON' end as parent_title, sha256(p.doc_id || ':' || p.title || ':' || p.content) as parent_id from c left join c p on p.doc_id = c.doc_id and p.title = case when starts_with(c.title, 'JSON.customers[') then 'JSON.customers' else 'JSON' end")
def datum_parent(spark, sf):
    return datum.split(_json_files(spark, sf)).select("doc_id", "title", "parent_title", "parent_id")


@query(f"{_DATUM}, n as (select doc_id, title, case when contains(title, '[') then 'record' else 'field' end as node_type from c where not starts_with(title, 'JSON.{datum.REST}')) select doc_id, title as name, node_type, case when node_type = 'field' then 'Data' else 'Collection' end as label, case when contains(title, '[') then 0 else 1 end::bigint as parents from n")
def datum_graph(spark, sf):
    nodes, edges = datum.graph(datum.split(_json_files(spark, sf)))
    up = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("parents"))
    return nodes.where("node_type <> 'data_kind'").join(up, "node_id", "left").select("doc_id", "name", "node_type", F.col("labels")[0].alias("label"), F.coalesce("parents", F.lit(0)).alias("parents"))


# ---- code: a Python text for each nation, a class whose methods are its customers, each calling the one before

_CODE = """m as (select c_nationkey::varchar as doc_id, c_custkey, row_number() over (partition by c_nationkey order by c_custkey)::int as k, lag(c_custkey) over (partition by c_nationkey order by c_custkey) as before from customer)"""


def _code_files(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    order = W.partitionBy("c_nationkey").orderBy("c_custkey")
    c = c.withColumn("before", F.lag("c_custkey").over(order))
    call = F.when(F.col("before").isNull(), F.lit("pass")).otherwise(F.concat(F.lit("self.c"), "before", F.lit("()")))
    one = F.struct("c_custkey", F.concat(F.lit("    def c"), "c_custkey", F.lit("(self):\n        "), call, F.lit("\n")).alias("t"))
    by = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n").alias("cs"))
    body = F.concat(F.lit("# nation "), "c_nationkey", F.lit("\nclass N"), "c_nationkey", F.lit(":\n"), "cs", F.lit("\nN"), "c_nationkey", F.lit("()\n"))
    return by.select(F.col("c_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("/src/n"), "c_nationkey", F.lit(".py")).alias("file_name"), body.alias("content"))


@query(f"""with {_CODE} select doc_id, k as sid, 'c' || c_custkey as name, 'N' || doc_id || '.c' || c_custkey as qualified, 'Function' as label, 0 as parent, 'def c' || c_custkey || '(self)' as signature, 'unexported' as visibility, '' as summary from m
union all select doc_id, 0, 'N' || doc_id, 'N' || doc_id, 'Class', -1, 'class N' || doc_id, 'exported', 'nation ' || doc_id from (select distinct doc_id from m) union all select doc_id, -1, 'n' || doc_id || ' (header)', '', '', -1, 'n' || doc_id || ' (header)', 'unexported', '' from (select distinct doc_id from m)""")
def code_split(spark, sf):
    return code.symbols(_code_files(spark, sf)).select("doc_id", "sid", "name", "qualified", "label", "parent", "signature", "visibility", "summary")


@query(f"with {_CODE} select doc_id, k as src, k - 1 as dst, 'CALLS' as type from m where before is not null")
def code_calls(spark, sf):
    files_ = _code_files(spark, sf)
    return code.resolve(code.relations(files_), code.symbols(files_))


_SPANS = "s as (select o_custkey as file, o_orderkey as sid, (epoch(o_orderdate) / 86400)::bigint as start, (epoch(o_orderdate) / 86400)::bigint + (o_totalprice::bigint % 400) as stop from orders)"


@query(f"""with {_SPANS} select a.file, a.sid, arg_min(b.sid, (b.stop - b.start, -b.sid)) as parent from s a left join s b on a.file = b.file and b.start <= a.start and a.stop <= b.stop and a.sid <> b.sid and (b.start < a.start or a.stop < b.stop or b.sid < a.sid) group by 1, 2""")
def code_containment(spark, sf):
    day = F.expr("cast(rint(unix_micros(cast(o_orderdate as timestamp)) / 86400000000D) as bigint)")  # halves go to the even number, as in DuckDB
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("sid"), day.alias("start"), (day + F.expr("cast(rint(o_totalprice) as bigint) % 400")).alias("end"))
    return code.containment(o, "file")


@query("select event_id, event_type, (props::json->>'k')::bigint as k from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


# ---- graph over the relational tables

_GRAPH = """nodes as (select 'r' || r_regionkey as node_id, 'Region' as label, r_name as name, 0.0::double as amount from region
 union all select 'n' || n_nationkey, 'Nation', n_name, 0 from nation union all select 'c' || c_custkey, 'Customer', c_name, c_acctbal from customer
 union all select 's' || s_suppkey, 'Supplier', s_name, s_acctbal from supplier union all select 'o' || o_orderkey, 'Order', o_orderstatus, o_totalprice from orders),
edges as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst, 'CONTAINS' as type from nation union all select 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' from customer
 union all select 's' || s_suppkey, 'n' || s_nationkey, 'BELONGS_TO' from supplier union all select 'c' || o_custkey, 'o' || o_orderkey, 'PLACED' from orders)"""


def tpch_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    def node(name, letter, key, label, title, amount="cast(0 as double)"):
        return table(spark, sf, name).select(F.expr(f"concat('{letter}', {key})").alias("node_id"), F.array(F.lit(label)).alias("labels"), F.expr(title).alias("name"), F.create_map(F.lit("amount"), F.expr(f"cast({amount} as string)"), F.lit("title"), F.expr(title)).alias("properties"))

    def edge(name, src, dst, kind):
        return table(spark, sf, name).select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(kind).alias("type"))

    nodes = node("region", "r", "r_regionkey", "Region", "r_name").unionAll(node("nation", "n", "n_nationkey", "Nation", "n_name")).unionAll(node("customer", "c", "c_custkey", "Customer", "c_name", "c_acctbal")).unionAll(node("supplier", "s", "s_suppkey", "Supplier", "s_name", "s_acctbal")).unionAll(node("orders", "o", "o_orderkey", "Order", "o_orderstatus", "o_totalprice"))
    edges = edge("nation", "concat('r', n_regionkey)", "concat('n', n_nationkey)", "CONTAINS").unionAll(edge("customer", "concat('n', c_nationkey)", "concat('c', c_custkey)", "CONTAINS")).unionAll(edge("supplier", "concat('s', s_suppkey)", "concat('n', s_nationkey)", "BELONGS_TO")).unionAll(edge("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)", "PLACED"))
    return nodes, edges


def _hops_sql(depth: int) -> str:
    steps = [f"{_GRAPH}, both_ as (select src as a, dst as b from edges union all select dst, src from edges), h0 as (select 'n1' as node_id, 0 as hops)"]
    for k in range(1, depth + 1):
        steps.append(f"h{k} as (select * from h{k - 1} union all select distinct b, {k} from h{k - 1} join both_ on node_id = a where hops = {k - 1} and b not in (select node_id from h{k - 1}))")
    return f"with {', '.join(steps)} select node_id, hops::int as hops from h{depth} where hops > 0"


def _around(depth: int):
    def run(spark, sf):
        return graph.neighbours(tpch_graph(spark, sf)[1], spark.createDataFrame([("n1",)], "node_id string"), depth)

    run.__name__ = f"graph_neighbors_{depth}"
    return run


for _depth in (1, 2, 3):
    query(_hops_sql(_depth))(_around(_depth))


@query(f"with {_GRAPH} select label, count(*)::bigint as n from nodes where label <> 'Region' group by 1")
def graph_label_counts(spark, sf):
    return graph.label_counts(tpch_graph(spark, sf)[0])


@query(f"with {_GRAPH} select node_id, name from nodes where label in ('Nation', 'Supplier')")
def graph_nodes_by_label(spark, sf):
    return graph.by_labels(tpch_graph(spark, sf)[0], ["Nation", "Supplier"]).select("node_id", "name")


@query("select 'p' || l_partkey as node_id, count(distinct l_orderkey)::bigint as chunks from lineitem where l_partkey in (select l_partkey from lineitem where l_orderkey in (1, 2, 3)) group by 1")
def graph_nodes_by_chunk(spark, sf):
    nodes = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("node_id")).agg(F.collect_set("l_orderkey").alias("source_chunk_ids"))
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "chunk_id long")
    return graph.by_chunks(nodes, chunks, "node_id").select("node_id", F.size("source_chunk_ids").cast("long").alias("chunks"))


@query(f"with {_GRAPH}, n as (select 'r0' as node_id, null as parent_id, 0 as depth union all select 'r1', null, 0), a as (select dst, src, 1 from edges where type = 'CONTAINS' and src in ('r0', 'r1')), b as (select e.dst, e.src, 2 from edges e join a on e.src = a.dst where type = 'CONTAINS') select node_id, parent_id::varchar as parent_id, depth::int as depth from (select * from n union all select * from a union all select * from b)")
def graph_region_tree(spark, sf):
    return graph.tree(tpch_graph(spark, sf)[1], spark.createDataFrame([("r0",), ("r1",)], "node_id string"))


@query(f"with {_GRAPH} select node_id, round(least(1.0::double, 0.3::double + 0.01::double * length(name) + 0.1::double * amount / 1000), 6) as score from nodes")
def graph_node_score(spark, sf):
    nodes = tpch_graph(spark, sf)[0]
    amount = F.col("properties")["amount"].cast("double")
    return nodes.select("node_id", F.round(graph.node_score(F.length("name"), amount / 1000), 6).alias("score"))


@query("select l_orderkey, l_linenumber, round(least(1.0::double, 0.2::double + 0.1::double * l_quantity / 50 + 0.1::double * l_discount), 6) as score from lineitem")
def graph_edge_score(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(graph.edge_score(F.col("l_quantity") / 50, F.col("l_discount")), 6).alias("score"))


@query(f"with {_GRAPH} select node_id, name from nodes where contains(name, 'A') or contains('A', name) order by node_id limit 20")
def graph_match_names(spark, sf):
    return graph.match_names(tpch_graph(spark, sf)[0], "A").select("node_id", "name")


@query(f"with {_GRAPH}, g as (select 'c' || c_custkey as node_id from customer where c_acctbal < 0) select src, dst, type from edges where src not in (select node_id from g) and dst not in (select node_id from g)")
def graph_detach_delete(spark, sf):
    nodes, edges = tpch_graph(spark, sf)
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    return graph.detach_delete(nodes, edges, gone)[1]


# ---- a graph of documents: a folder for each language and source, an entity for each seventh of the ids

_DOCS = """d as (select doc_id, 'd' || doc_id as node_id, '/' || lang || '/' || source as dir, 'f' || doc_id as file from documents),
g as (select dir, sha256(dir) as region from (select distinct dir from d)),
nodes as (select region as node_id, 'Region' as label, regexp_extract(dir, '([^/]*)$', 1) as name from g union all select node_id, 'Document', 'doc' || doc_id from d union all select 'e' || k, 'Entity', 'entity' || k from (select distinct doc_id % 7 as k from d)),
edges as (select region as src, node_id as dst, 'CONTAINS' as type from d join g using (dir) union all select node_id, 'e' || (doc_id % 7), 'HAS' from d),
both_ as (select src as a, dst as b from edges union all select dst, src from edges)"""


def document_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", F.expr("concat('d', doc_id)").alias("node_id"), F.expr("concat('/', lang, '/', source)").alias("dir"), F.expr("concat('F', doc_id)").alias("file_name"))
    none = F.create_map().cast("map<string,string>")
    nodes = d.select("node_id", F.array(F.lit("Document")).alias("labels"), F.expr("concat('doc', doc_id)").alias("name"), none.alias("properties"), F.array("doc_id").alias("docs"))
    entity = d.select((F.col("doc_id") % 7).alias("k")).distinct().select(F.expr("concat('e', k)").alias("node_id"), F.array(F.lit("Entity")).alias("labels"), F.expr("concat('entity', k)").alias("name"), none.alias("properties"), F.array().cast("array<bigint>").alias("docs"))
    links = d.select("node_id", F.expr("concat('e', doc_id % 7)").alias("dst")).select(ids.digest(F.col("node_id"), F.lit("HAS"), F.col("dst")).alias("edge_id"), F.col("node_id").alias("src"), "dst", F.lit("HAS").alias("type"))
    return tuple(map(cut, graph.save_roots(nodes.unionByName(entity), links, d)))


@query(f"with {_DOCS}, s as (select sha256('/en/src1') as node_id union select node_id from d where starts_with(dir, '/en/src1')), r as (select node_id from s union select b from s join both_ on a = node_id) select node_id, name, label from nodes where node_id in (select node_id from r)")
def explore_region(spark, sf):
    return graph.explore_region(*document_graph(spark, sf), "/en/src1")[0].select("node_id", "name", F.col("labels")[0].alias("label"))


@query(f"with {_DOCS}, s as (select sha256('/en/src1') as node_id union select node_id from d where starts_with(dir, '/en/src1')) select src, dst, type from edges where src in (select node_id from s) or dst in (select node_id from s)")
def explore_region_edges(spark, sf):
    return graph.explore_region(*document_graph(spark, sf), "/en/src1")[1].select("src", "dst", "type")


@query(f"with {_DOCS}, s as (select node_id, dir from d where doc_id = 5), r1 as (select node_id from s union select b from s join both_ on a = node_id), r2 as (select node_id from r1 union select b from r1 join both_ on a = node_id) select node_id, name from nodes where node_id in (select node_id from r2)")
def explore_file(spark, sf):
    d = table(spark, sf, "documents").where("doc_id = 5").selectExpr("concat('/', lang, '/', source) as dir").first()
    return graph.explore_file(*document_graph(spark, sf), d.dir, "f5")[0].select("node_id", "name")


@query(f"with {_DOCS} select count(*)::bigint as n from d where starts_with(dir, '/en/src1')")
def count_by_region(spark, sf):
    return graph.count_by_region(document_graph(spark, sf)[0], "/en/src1")


@query(f"with {_DOCS} select region as node_id, null::varchar as parent_id, 'Region' as type, regexp_extract(dir, '([^/]*)$', 1) as name, 0 as depth from g union all select node_id, region, 'Document', 'doc' || doc_id, 1 from d join g using (dir) union all select 'k' || doc_id, 'd' || doc_id, 'Chunk', lang, 2 from documents")
def document_tree(spark, sf):
    chunks = table(spark, sf, "documents").select(F.expr("concat('k', doc_id)").alias("chunk_id"), F.col("lang").alias("title"), "doc_id")
    return graph.document_tree(*document_graph(spark, sf), chunks)


_SEARCH = f"""with {_GRAPH}, seeds as (select node_id from nodes where contains(name, '1') or contains('1', name) order by node_id limit 20), both_ as (select src as a, dst as b from edges union select dst, src from edges),
m as (select a, b from (select a, b, row_number() over (partition by a order by b) as r from seeds join both_ on a = node_id) where r <= 10),
i as (select node_id, max(seed) as seed from (select node_id, 1 as seed from seeds union all select b, 0 from m) group by 1)"""


@query(f"{_SEARCH} select n.node_id, i.seed = 1 as seed, 0.3::double as score from nodes n join i using (node_id)")
def search_graph(spark, sf):
    return graph.search(*tpch_graph(spark, sf), "1")[0]


@query(f"{_SEARCH} select distinct src, dst, type, 0.2::double as score from edges e join (select a, b from m union select b, a from m) p on e.src = p.a and e.dst = p.b")
def search_graph_edges(spark, sf):
    return graph.search(*tpch_graph(spark, sf), "1")[1]


@query(f"""{_SEARCH}, q as (select embedding as e from embeddings where vec_id = 0), c as (select vec_id, row_number() over (order by {_COS} desc, vec_id) as r from embeddings, q), n as (select node_id, row_number() over (order by node_id) as r from i join nodes using (node_id))
select 'chunks' as collection, vec_id::varchar as id, round(1 / (60.0::double + r), 9) as score from c where r <= 50 union all select 'nodes', node_id, round(0.7::double / (60 + r), 9) from n""")
def hyper_search(spark, sf):
    v, q = _vectors(spark, sf)
    semantic = vector.top_k(v, q[0], 50).select(F.lit("chunks").alias("collection"), F.col("vec_id").cast("string").alias("id"), F.struct("score", (-F.col("vec_id")).alias("v")).alias("score"))
    nodes = graph.search(*tpch_graph(spark, sf), "1")[0].select(F.lit("nodes").alias("collection"), F.col("node_id").alias("id"), "score")
    return result.rrf([(semantic, 1.0), (nodes, 0.7)], "id", by=["collection"])


@query(f"with {_GRAPH} select src, dst, type from edges where type <> 'PLACED'")
def graph_delete_edges(spark, sf):
    edges = tpch_graph(spark, sf)[1].withColumn("edge_id", ids.digest(F.col("src"), F.col("type"), F.col("dst")))
    return graph.delete_edges(edges, edges.where("type = 'PLACED'").select("edge_id")).select("src", "dst", "type")


@query("select 'p' || p_partkey as node_id from part where p_partkey not in (select l_partkey from lineitem where l_orderkey in (1, 2, 3))")
def graph_remove_chunks(spark, sf):
    nodes = table(spark, sf, "part").select(F.expr("concat('p', p_partkey)").alias("node_id")).join(table(spark, sf, "lineitem").groupBy(F.expr("concat('p', l_partkey)").alias("node_id")).agg(F.collect_set("l_orderkey").alias("source_chunk_ids")), "node_id", "left")
    edges = table(spark, sf, "lineitem").select(F.expr("concat(l_orderkey, '-', l_linenumber)").alias("edge_id"), F.expr("concat('s', l_suppkey)").alias("src"), F.expr("concat('p', l_partkey)").alias("dst"), F.array("l_orderkey").alias("source_chunk_ids"))
    return graph.remove_chunks(nodes, edges, spark.createDataFrame([(1,), (2,), (3,)], "chunk_id long"))[0].select("node_id")


@query("select doc_id, lang from documents where lower(lang) = 'en' or lower(source) = 'src3'")
def tag_match(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.exists(F.array("lang", "source"), lambda t: F.lower(t).isin("en", "src3"))).select("doc_id", "lang")


@query(f"with {_GRAPH} select s.node_id as supplier, c.node_id as customer from nodes s join edges e on e.type = 'BELONGS_TO' and e.src = s.node_id join edges f on f.type = 'CONTAINS' and f.src = e.dst join nodes c on c.node_id = f.dst and c.label = 'Customer' where s.label = 'Supplier' and s.amount > 9000 and c.amount > 9000")
def cypher_path(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (s:Supplier)-[:BELONGS_TO]->(n:Nation)-[:CONTAINS]->(c:Customer) WHERE s.amount > 9000 AND NOT c.amount <= 9000 RETURN s.ID AS supplier, c.ID AS customer")


@query(f"with {_GRAPH} select a.node_id as a, b.node_id as b from edges e join nodes a on a.node_id = e.src join nodes b on b.node_id = e.dst where a.label = 'Nation' and e.type in ('CONTAINS', 'BELONGS_TO') and b.name <> 'x OR y' union all select a.node_id, b.node_id from edges e join nodes a on a.node_id = e.dst join nodes b on b.node_id = e.src where a.label = 'Nation' and e.type in ('CONTAINS', 'BELONGS_TO')")
def cypher_both_ways(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (a:Nation)-[r:CONTAINS|BELONGS_TO]-(b) WHERE b.name <> 'x OR y' RETURN a.ID AS a, b.ID AS b")


@query(f"with {_GRAPH} select name from nodes where label = 'Supplier' order by amount desc, node_id limit 9")
def cypher_order_hidden(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (s:Supplier) WITH s RETURN s.name AS name ORDER BY s.amount DESC, s.ID LIMIT 9")


@query(f"with {_GRAPH} select node_id, case when amount < 0 then 'yes' end as debt from nodes where label <> 'Supplier' and node_id in (select src from edges union select dst from edges) and label = 'Customer' union all select 'new', 'no'")
def cypher_write(spark, sf):
    nodes, edges = tpch_graph(spark, sf)
    for statement in ("MATCH (c:Customer) WHERE c.amount < 0 SET c.debt = 'yes'", "MERGE (n:Customer {ID: 'new', debt: 'no'})", "MATCH (s:Supplier) DETACH DELETE s", "MATCH (n:Nation {ID: 'n1'}), (n)-[:CONTAINS]->(c:Customer) CREATE (c)-[:LIVES]->(n)"):
        nodes, edges, _ = cypher.execute(nodes, edges, statement)
    touched = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).union(spark.createDataFrame([("new",)], "node_id string")).distinct()
    return graph.by_labels(nodes, ["Customer"]).join(touched, "node_id", "left_semi").select("node_id", F.try_element_at("properties", F.lit("debt")).alias("debt"))


@query(f"with {_GRAPH} select 'amount' as field, 'number' as type, count(*)::bigint as n from nodes where label = 'Customer' union all select 'title', 'string', count(*) from nodes where label = 'Customer'")
def view_describe(spark, sf):
    return view.describe(tpch_graph(spark, sf)[0], "Customer")


@query(f"with {_GRAPH} select n.node_id, n.amount::varchar as amount from nodes n where n.label = 'Supplier' order by n.amount, n.node_id limit 20")
def view_order_numbers(spark, sf):
    return view.query(tpch_graph(spark, sf)[0], view.Spec("Supplier", order=[("amount", False)], columns=["amount"]), ["title", "amount"])


# ---- Cypher and views

@query(f"with {_GRAPH} select name, amount::varchar as amount from nodes where label = 'Customer' and amount > 9000 and contains(name, '1')")
def cypher_match_where(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (c:Customer) WHERE c.amount > 9000 AND c.name CONTAINS '1' RETURN c.name AS name, c.amount AS amount")


@query(f"with {_GRAPH} select a.name as nation, b.name as customer from nodes a join edges e on a.node_id = e.src join nodes b on b.node_id = e.dst where a.label = 'Nation' and b.label = 'Customer' and e.type = 'CONTAINS' and a.node_id in ('n1', 'n2')")
def cypher_relation(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (a:Nation)-[r:CONTAINS]->(b:Customer) WHERE a.ID IN ['n1', 'n2'] RETURN a.name AS nation, b.name AS customer")


@query(f"with {_GRAPH} select a.name as nation, count(*)::bigint as suppliers from nodes a join edges e on a.node_id = e.dst join nodes b on b.node_id = e.src where a.label = 'Nation' and b.label = 'Supplier' and e.type = 'BELONGS_TO' group by 1")
def cypher_count(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (a:Nation)<-[r:BELONGS_TO]-(b:Supplier) RETURN a.name AS nation, count(b) AS suppliers")


@query(f"with {_GRAPH} select name from nodes where label = 'Supplier' order by name desc limit 7 offset 3")
def cypher_order_skip_limit(spark, sf):
    return cypher.run(*tpch_graph(spark, sf), "MATCH (s:Supplier) RETURN s.name AS name ORDER BY name DESC SKIP 3 LIMIT $n", {"n": 7})


@query(f"with {_GRAPH} select node_id, name as title from nodes where label = 'Customer' and amount between 100 and 5000 and contains(name, '2') order by name desc, node_id limit 15 offset 15")
def view_query(spark, sf):
    spec = view.Spec("Customer", between={"amount": (100, 5000)}, contains={"title": "2"}, order=[("title", True), ("nope", False)], columns=["title"], page=2, size=15)
    return view.query(tpch_graph(spark, sf)[0], spec, ["title", "amount"])


@query(f"with {_GRAPH} select count(*)::bigint as total from nodes where label = 'Customer' and amount between 100 and 5000 and contains(name, '2')")
def view_total(spark, sf):
    spec = view.Spec("Customer", between={"amount": (100, 5000)}, contains={"title": "2"})
    return view.matching(tpch_graph(spark, sf)[0], spec, ["title", "amount"]).agg(F.count("*").alias("total"))


# ---- metadata

@query("select event_type as status, count(*)::bigint as n from events group by 1")
def meta_status_counts(spark, sf):
    return meta.count_by_status(table(spark, sf, "events"), "event_type")


@query("select user_id, coalesce(sum((props::json->>'k')::bigint), 0)::bigint as total, max_by(event_type, event_id) as latest from events group by 1")
def meta_usage_totals(spark, sf):
    return meta.usage_totals(table(spark, sf, "events"), "user_id", F.get_json_object("props", "$.k").cast("long"), F.col("event_type"), "event_id")


@query("select event_id, event_type from events order by ts desc, event_id desc limit 25")
def meta_recent(spark, sf):
    return meta.recent(table(spark, sf, "events"), "ts", "event_id", 25).select("event_id", "event_type")


@query("select doc_id, case when doc_id % 10 = 0 then 'new' when doc_id % 10 = 1 and n_chars % 2 = 0 then 'changed' else 'same' end as change from documents union all select doc_id + 10000000, 'deleted' from documents where doc_id % 25 = 0")
def meta_changes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("size"), F.lit(0).alias("mtime"), ids.content_hash(F.col("text")).alias("hash"))
    known = d.where("doc_id % 10 <> 0").withColumn("size", F.expr("case when doc_id % 10 = 1 and size % 2 = 0 then size + 1 else size end"))
    known = known.unionByName(d.where("doc_id % 25 = 0").withColumn("doc_id", F.col("doc_id") + 10000000))
    return meta.changes(d, known, "doc_id")


@query("""with c as (select conv_id as doc_id, max((turn = 3)::int) as has3, min(case when turn = 0 then 1 else 0 end) as one from conversations group by 1)
select doc_id, case when has3 = 1 then 'Full' when doc_id % 2 = 0 then 'SkipAll' else 'SkipRefill' end as action from c""")
def meta_chunk_diff(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index")).agg(F.min("role").alias("title"), F.min("text").alias("content"))
    old = c.withColumn("summary", F.when(F.col("doc_id") % 2 == 0, "s").otherwise(""))
    new = old.withColumn("title", F.when(F.col("index") == 3, "other").otherwise(F.col("title")))
    return meta.chunk_diff(old, new)


@query("select doc_id, source from documents where lower(source) = 'src1' or lower(source) like 'src1/%'")
def path_prefix(spark, sf):
    return table(spark, sf, "documents").where(vector.under(F.col("source"), "SRC1/")).select("doc_id", "source")


@query("select source, count(*)::bigint as documents, sum(n_chars)::bigint as size from documents group by 1")
def folder_sizes(spark, sf):
    return meta.folder_sizes(table(spark, sf, "documents"), "source", "n_chars")


@query("select conv_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by 1")
def document_rebuild(spark, sf):
    return vector.rebuild(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("""select 'p' || doc_id as path, 'indexed' as status, 'p' || doc_id as file_name, '' as ext from documents where doc_id % 3 <> 0 union all select '/a/p' || doc_id || '.MD', 'pending', 'p' || doc_id || '.MD', 'md' from documents where doc_id % 3 = 0
union all select 'p' || doc_id, 'failed', 'p' || doc_id, '' from documents where doc_id % 3 = 0""")
def meta_put(spark, sf):
    d = table(spark, sf, "documents")
    known = d.selectExpr("concat('p', doc_id) as path", "'indexed' as status", "concat('p', doc_id) as file_name", "'' as ext")
    new = d.where("doc_id % 3 = 0").selectExpr("concat('/a/p', doc_id, '.MD') as path", "'pending' as status").unionAll(d.where("doc_id % 3 = 0").selectExpr("concat('p', doc_id)", "'failed'"))
    return meta.put(known, new)


@query("select source as path, count(*)::bigint as n from documents where lang = 'en' and (lower(source) = 'src1' or lower(source) like 'src1/%') group by 1")
def meta_status_filter(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("lang").alias("status"))
    return meta.with_status(d, "en", "src1").groupBy("path").agg(F.count("*").alias("n"))


@query("select event_id, case when event_type = 'view' then 'seen' when event_id % 2 = 0 then 'old' || event_id else '' end as summary from events")
def meta_resume(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), F.when(F.col("event_type") == "view", "seen").otherwise("").alias("summary"))
    done = e.where("chunk_id % 2 = 0").withColumn("summary", F.expr("concat('old', chunk_id)"))
    return meta.resume(e, done).withColumnRenamed("chunk_id", "event_id")


@query("select c_custkey as src, s_suppkey as dst, c_mktsegment as type from customer join supplier on s_nationkey = c_nationkey and s_suppkey % 10 = c_custkey % 10")
def meta_relations(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    key = lambda k, n: F.concat_ws("-", F.col(n), F.col(k) % 10)
    rel = c.select(F.concat(F.lit("c"), "c_custkey").alias("subject"), F.col("c_mktsegment").alias("predicate"), key("c_custkey", "c_nationkey").alias("object"))
    ent = c.select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_custkey").alias("entity_id")).unionAll(s.select(key("s_suppkey", "s_nationkey"), "s_suppkey"))
    return meta.relations_to_ids(rel, ent)
