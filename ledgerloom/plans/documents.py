"""Registered queries: text, chunks, retrieval and numbers over documents, conversations, pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.operators import relational as R
from ledgerloom.operators import retrieval as K
from ledgerloom.plans.registry import Registry, spread, table

registry = Registry()
query = registry.query

_TOK = r"[\p{L}\p{N}]+"


# ------------------------------------------------------------------ text


@query(r"""SELECT doc_id, md5(trim(regexp_replace(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), ''), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


@query(rf"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(line) AS n FROM ({_LINES}) WHERE regexp_matches(line, '(?i)^(page\s+)?[-–—]?\s*\(?[ivxlc\d]{{1,4}}\)?\s*[-–—]?$') OR length(line) < 12""")
def page_number_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).where(T.is_page_number(F.col("line")) | (F.length("line") < 12))
    return rows.select("doc_id", "pos", F.length("line").cast("long").alias("n"))


@query(rf"""WITH l AS (SELECT doc_id, regexp_replace(lower(line), '\d+', '#', 'g') AS k FROM ({_LINES}) WHERE length(line) BETWEEN 1 AND 80),
c AS (SELECT doc_id, k, count(*) AS n FROM l GROUP BY ALL) SELECT doc_id, count(*) AS n_repeated, max(n) AS most FROM c WHERE n >= 3 GROUP BY 1""")
def running_header_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).where(F.length("line").between(1, 80))
    counts = lines.groupBy("doc_id", F.regexp_replace(F.lower("line"), r"\d+", "#").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_repeated"), F.max("n").alias("most"))


@query("""SELECT page_id, CASE WHEN strlen(html) < 2000 THEN 'too small' WHEN NOT (contains(lower(substr(html, 1, 10000)), '<html') OR contains(lower(substr(html, 1, 10000)), '<?xml')) THEN 'not an HTML document'
WHEN NOT contains(html, 'lang="de"') THEN 'never mentions its form' END AS reason FROM pages""")
def doc_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return rows.select("page_id", T.validate_document(F.col("content"), F.lit('lang="de"'), 2000).alias("reason"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc/' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def uuid5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.uuid5(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("id"))


@query("""SELECT doc_id, CASE WHEN ('0x' || right(md5(CAST(doc_id AS VARCHAR)), 1))::INT % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents""")
def hash_split_md5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.split_of(F.col("doc_id").cast("string")).alias("split"))


@query("""SELECT doc_id, md5(concat_ws(chr(10), 'lang: ' || nullif(lang, ''), 'source: ' || nullif(source, '')) || chr(10) || chr(10) || text) AS digest FROM documents""")
def embed_header_text(spark: SparkSession, sf: str) -> DataFrame:
    body = T.header_text({"lang": F.col("lang"), "source": F.col("source")}, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(body).alias("digest"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '(?i)\b(compare[ds]?|comparison|versus|vs\.?|than|change[ds]? from|between|both|relative to|a year earlier|year[- ]over[- ]year|trend(ed|s)?|over the (last|past)|each of|and \w+''s)\b') AS multi_fact,
contains(lower(text), 'do not contain this information') AS refused, regexp_matches(text, '\[\d+\]') AS cited FROM conversations""")
def router_cues(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.needs_decomposition(text).alias("multi_fact"), T.is_refusal(text).alias("refused"), T.is_cited(text).alias("cited"))


@query("""SELECT role, count(*) AS n, round(avg(contains(lower(text), 'do not contain this information')::INT), 6) AS refused FROM conversations GROUP BY 1""")
def refusal_rate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.is_refusal(F.col("text")).cast("int")), 6).alias("refused"))


@query(r"""SELECT doc_id, k AS rule FROM documents, (VALUES ('en_the', 'en', 'the'), ('de_und', 'de', 'und'), ('any_licensed', NULL, 'licensed under')) r(k, l, t)
WHERE (r.l IS NULL OR r.l = lang) AND contains(lower(text), r.t)""")
def rule_match(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("en_the", "en", "the"), ("de_und", "de", "und"), ("any_licensed", None, "licensed under")], "rule string, l string, t string")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("low"))
    fits = (F.col("l").isNull() | (F.col("l") == F.col("lang"))) & F.contains(F.col("low"), F.col("t"))
    return docs.join(F.broadcast(rules), fits).select("doc_id", "rule")  # a fixed list of rules


# ------------------------------------------------------------------ chunks

CHUNK, OVERLAP = 200, 40


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents)
SELECT doc_id, CAST(g.i AS INTEGER) AS chunk, md5(array_to_string(list_slice(t, g.i * 160 + 1, g.i * 160 + 200), ' ')) AS digest, len(list_slice(t, g.i * 160 + 1, g.i * 160 + 200)) AS n
FROM t, LATERAL (SELECT unnest(generate_series(0, greatest(CAST(ceil((len(t) - 200) / 160.0) AS BIGINT), 0))) AS i) g WHERE len(t) > 0""")
def word_window_chunks(spark: SparkSession, sf: str) -> DataFrame:
    step = CHUNK - OVERLAP
    rows = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    last = F.greatest(F.ceil((F.size("t") - CHUNK) / step), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("t", i * step + 1, F.lit(CHUNK)))
    rows = rows.select("doc_id", F.posexplode(parts).alias("chunk", "w"))
    return rows.select("doc_id", "chunk", F.md5(F.array_join("w", " ")).alias("digest"), F.size("w").cast("long").alias("n"))


@query(rf"""WITH t AS (SELECT lang, len(regexp_extract_all(text, '{_TOK}')) AS n FROM documents)
SELECT lang, count(*) AS docs, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS p95, max(n) AS most, count(*) FILTER (n < 50) AS short FROM t GROUP BY 1""")
def chunk_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", F.size(F.regexp_extract_all("text", F.lit(_TOK), F.lit(0))).cast("long").alias("n"))
    q = lambda p: F.floor(F.percentile("n", F.lit(p)))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("n").alias("most"), F.count_if(F.col("n") < 50).alias("short"))


@query(f"""WITH RECURSIVE l AS ({_LINES}), s AS (SELECT doc_id, pos, length(line) AS c FROM l),
f AS (SELECT doc_id, pos, c AS size, 0 AS g FROM s WHERE pos = 0 UNION ALL
SELECT s.doc_id, s.pos, CASE WHEN f.size + s.c > 600 THEN s.c ELSE f.size + s.c END, f.g + CASE WHEN f.size + s.c > 600 THEN 1 ELSE 0 END FROM f JOIN s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1)
SELECT doc_id, g AS grp, count(*) AS lines, CAST(max(size) AS BIGINT) AS chars FROM f GROUP BY 1, 2""")
def greedy_pack_lines(spark: SparkSession, sf: str) -> DataFrame:
    items = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.length(x).alias("c")))
    rows = table(spark, sf, "documents").select("doc_id", items.alias("items"))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("items", R.greedy_groups(F.col("items"), "c", 600).alias("grp"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.grp").alias("grp")).agg(F.count(F.lit(1)).alias("lines"), F.sum("x.items.c").cast("long").alias("chars"))


# ------------------------------------------------------------------ BM25

_POSTS = rf"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents),
d AS (SELECT doc_id, len(t) AS length, t FROM t WHERE len(t) > 0), c AS (SELECT count(*) AS n, avg(length) AS avg_len FROM d),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"""
_SCORES = rf"""{_POSTS}, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))) AS score FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY ALL)"""


@query(f"WITH {_POSTS} SELECT lang, count(*) AS postings, sum(tf)::BIGINT AS tokens, count(DISTINCT term) AS terms FROM p JOIN documents USING (doc_id) GROUP BY 1")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    posts = K.postings(table(spark, sf, "documents"), keep=("lang",))
    per = posts.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    return per.groupBy("lang").agg(F.sum("n").alias("postings"), F.sum("tf").alias("tokens"), F.count(F.lit(1)).alias("terms"))


@query(f"WITH {_POSTS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, c WHERE df >= 5")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("text")
    n = docs.where(F.rlike("text", F.lit(T.TOKEN))).count()
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 5")
    return df.select("term", "df", F.round(K.idf(F.lit(n), F.col("df")), 6).alias("idf"))


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return K.bm25_top(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k)


def _top_sql(k: int) -> str:
    return f"SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= {k}"


@query(f"WITH {_SCORES} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM ({_top_sql(10)})")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 10).withColumn("score", F.round("score", 6))


@query(rf"""WITH {_SCORES}, b AS ({_top_sql(20)}), x AS (SELECT item_id, doc_id, list_distinct(regexp_extract_all(lower(q.text), '{_TOK}')) AS qt, regexp_extract_all(lower(d.text), '{_TOK}') AS dt
FROM b JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id)), y AS (SELECT item_id, doc_id, len(list_intersect(qt, dt)) / len(qt) AS score FROM x WHERE len(qt) > 0)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM y QUALIFY rank <= 5""")
def lexical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    out = K.rerank(_bm25(spark, sf, 20).select("item_id", "doc_id"), table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", 5)
    return out.withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------ vectors, fusion

_COS = """cosine AS (SELECT q.vec_id AS qid, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
euclid AS (SELECT q.vec_id AS qid, v.vec_id, -list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cosine QUALIFY rank <= 30),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM euclid QUALIFY rank <= 30)"""


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v")))


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return K.nearest(_queries(spark, sf), _vectors(spark, sf), k, "qid", "vec_id")


def _lists(spark: SparkSession, sf: str, *by: str, k: int = 30) -> DataFrame:
    """The lists by several measures, from one pass over the vectors; list_no in the given order."""
    return K.nearest_lists(_queries(spark, sf), _vectors(spark, sf), k, "qid", "vec_id", by)


@query(f"WITH {_COS} SELECT qid, vec_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_COS}, u AS (SELECT qid, vec_id, rank, 0 AS l FROM dense UNION ALL SELECT qid, vec_id, rank, 1 FROM sparse),
f AS (SELECT qid, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((l, rank)) AS first FROM u GROUP BY ALL)
SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, vec_id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return K.rrf(_lists(spark, sf, "cosine", "distance"), "qid", "vec_id", 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {_COS}, a AS (SELECT qid, vec_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS x FROM dense WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, vec_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS x FROM sparse WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, vec_id, 0.3 * coalesce(a.x, 0) + 0.7 * coalesce(b.x, 0) AS score FROM a FULL JOIN b USING (qid, vec_id))
SELECT qid, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM f QUALIFY rank <= 10""")
def relative_fusion(spark: SparkSession, sf: str) -> DataFrame:
    pairs = K.scaled_pairs(_lists(spark, sf, "cosine", "distance"), "qid", "vec_id")
    return K.relative_fusion_of(pairs, "qid", "vec_id", 10).withColumn("score", F.round("score", 6))


_POOL = f"""{_COS}, u AS (SELECT qid, vec_id, min((l, rank)) AS place FROM (SELECT qid, vec_id, rank, 0 AS l FROM sparse WHERE rank <= 30 UNION ALL SELECT qid, vec_id, rank, 1 FROM dense WHERE rank <= 30) GROUP BY ALL)"""


@query(f"WITH {_POOL} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY place, vec_id) AS rank FROM u")
def candidate_pool_union(spark: SparkSession, sf: str) -> DataFrame:
    return K.candidate_pool("union_30_30", _lists(spark, sf, "distance", "cosine"), "qid", "vec_id")


@query(f"""WITH {_COS}, u AS (SELECT qid, vec_id, min((rank, l)) AS place FROM (SELECT qid, vec_id, rank, 0 AS l FROM sparse UNION ALL SELECT qid, vec_id, rank, 1 FROM dense) GROUP BY ALL)
SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY place, vec_id) AS rank FROM u QUALIFY rank <= 8""")
def round_robin_interleave(spark: SparkSession, sf: str) -> DataFrame:
    return K.interleave(_lists(spark, sf, "distance", "cosine"), "qid", "vec_id", 8)


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY md5(CAST(turn AS VARCHAR)), turn) AS k FROM conversations),
f AS (SELECT conv_id, k, CASE WHEN cost <= 800 THEN cost ELSE 0 END AS used, cost <= 800 AS taken, turn, cost FROM c WHERE k = 1 UNION ALL
SELECT c.conv_id, c.k, f.used + CASE WHEN f.used + c.cost <= 800 THEN c.cost ELSE 0 END, f.used + c.cost <= 800, c.turn, c.cost FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS place, turn AS unit, cost FROM f WHERE taken""")
def parent_budget_expand(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("tokens"))
    w = Window.partitionBy("conv_id").orderBy(F.md5(F.col("turn").cast("string")), "turn")
    key = F.struct("conv_id", "turn")
    hits = turns.select("conv_id", key.alias("child"), F.row_number().over(w).alias("rank"))
    children = turns.select(key.alias("child"), F.lit(None).cast("struct<conv_id:bigint,turn:bigint>").alias("parent"), "tokens")
    parents = children.select("parent", F.col("tokens")).limit(0)
    out = K.expand_to_parents(hits, children, parents, "conv_id", budget=800)
    return out.select("conv_id", "place", F.col("unit.turn").alias("unit"), "cost")


# ------------------------------------------------------------------ numbers

_NUM = r"(?:^|[^A-Za-z0-9])(\$?\(?-?\d[\d,]*(?:\.\d+)?\)?)"


@query("""SELECT o_orderkey, CASE WHEN abs(v - round(v)) < 1e-9 THEN format('{:,}', CAST(round(v) AS BIGINT)) WHEN abs(v) >= 1 THEN rtrim(rtrim(format('{:,.2f}', v), '0'), '.') ELSE rtrim(format('{:.4f}', v), '0') END AS shown
FROM (SELECT o_orderkey, floor(o_totalprice * 4) / 400 AS v FROM orders)""")
def format_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") * 4) / 400).alias("v"))
    return rows.select("o_orderkey", N.format_number(F.col("v")).alias("shown"))


@query("""WITH k AS (SELECT o_orderkey, unnest(CASE WHEN t >= 1000 THEN list_distinct([t, round(t / 1000, 1), round(t / 1000, 2)]) ELSE [t] END) AS key FROM (SELECT o_orderkey, floor(o_totalprice) AS t FROM orders)),
s AS (SELECT DISTINCT round(p_retailprice / 10, 1) AS key FROM part) SELECT o_orderkey, count(*) AS n FROM k JOIN s USING (key) GROUP BY 1""")
def theta_match_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Stated numbers against source values: a theta match made an equi-join by exploding what a value may be stated as."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("t"))
    keys = orders.select("o_orderkey", F.explode(N.candidate_keys(F.col("t"))).alias("key"))
    stated = table(spark, sf, "part").select(F.round(F.col("p_retailprice") / 10, 1).alias("key")).distinct()
    return keys.join(stated, "key").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_partkey % 50) AS s FROM lineitem GROUP BY 1)
SELECT x.l_orderkey, round(len(list_intersect(x.s, y.s)) / len(x.s), 6) AS overlap FROM a x JOIN a y ON y.l_orderkey = x.l_orderkey + 1""")
def table_overlap(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("s"))
    shifted = sets.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("other"))
    return sets.join(shifted, "l_orderkey").select("l_orderkey", F.round(F.size(F.array_intersect("s", "other")) / F.size("s"), 6).alias("overlap"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUM}', 1)) AS token FROM documents),
v AS (SELECT doc_id, token, abs(TRY_CAST(trim(translate(token, '$,', ''), '()') AS DOUBLE)) AS v FROM t)
SELECT doc_id, count(*) AS n_numbers, count(*) FILTER (contains(token, '$') OR regexp_matches(token, '\d,\d') OR NOT (v = floor(v) AND (v BETWEEN 1900 AND 2100 OR v <= 31))) AS n_claims, max(v) AS largest FROM v WHERE v IS NOT NULL GROUP BY 1""")
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_NUM), F.lit(1))).alias("token"))
    rows = rows.withColumn("v", F.abs(N.token_value(F.col("token")))).where("v is not null")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.count_if(N.is_claim(F.col("token"), F.col("v"))).alias("n_claims"), F.max("v").alias("largest"))


@query(rf"""WITH a AS (SELECT conv_id, text FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, string_agg(text, ' ') AS src FROM conversations WHERE role <> 'assistant' GROUP BY 1),
c AS (SELECT conv_id, unnest(regexp_extract_all(text, '{_NUM}', 1)) AS token FROM a), s AS (SELECT conv_id, unnest(regexp_extract_all(src, '{_NUM}', 1)) AS token FROM u),
cv AS (SELECT conv_id, token, abs(TRY_CAST(trim(translate(token, '$,', ''), '()') AS DOUBLE)) AS v FROM c), sv AS (SELECT DISTINCT conv_id, abs(TRY_CAST(trim(translate(token, '$,', ''), '()') AS DOUBLE)) AS v FROM s)
SELECT conv_id, count(*) AS claims, count(*) FILTER (NOT EXISTS (SELECT 1 FROM sv WHERE sv.conv_id = cv.conv_id AND sv.v = cv.v)) AS unsupported FROM cv WHERE v IS NOT NULL GROUP BY 1""")
def verify_numbers(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all("text", F.lit(_NUM), F.lit(1))).alias("token"))
    turns = turns.withColumn("v", F.abs(N.token_value(F.col("token")))).where("v is not null")
    known = turns.where("role <> 'assistant'").select("conv_id", "v").distinct().withColumn("known", F.lit(1))
    claims = turns.where("role = 'assistant'").join(known, ["conv_id", "v"], "left")
    return claims.groupBy("conv_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("known").isNull()).alias("unsupported"))


_PRICES = "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders"


@query(f"""SELECT o_orderkey, 5 AS n_numbers, 3 + (p < 1000 AND round(p / 1000.0, 1) NOT IN (0, 1))::INT AS n_claims, 1 + (p < 1000 AND round(p / 1000.0, 1) NOT IN (0, 1))::INT AS n_unsupported FROM ({_PRICES}) WHERE p < 1000
UNION ALL SELECT o_orderkey, 5, 2 + (NOT (t = floor(t) AND t <= 31))::INT, 1 FROM (SELECT *, round(p / 1000.0, 1) AS t FROM ({_PRICES}) WHERE p >= 1000)""")
def verify_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a right amount, the same in thousands, one that no source has, a year and a citation: which are claims, and which lack support."""
    p = F.floor("o_totalprice").cast("long")
    amount = lambda v: F.concat(F.lit("$"), F.format_number(v, 0))
    answer = F.concat(F.lit("The total was "), amount(p), F.lit(" [1] or "), F.format_string("%.1f", p / 1000), F.lit(" thousand and not "), amount(p + 1), F.lit(" in 2024."))
    rows = table(spark, sf, "orders").select("o_orderkey", answer.alias("answer"), F.concat(F.lit("Total: "), amount(p)).alias("sources"))
    return rows.select("o_orderkey", F.size(N.number_tokens(F.col("answer"))).alias("n_numbers"), F.size(N.claims(F.col("answer"))).alias("n_claims"), F.size(N.unsupported(F.col("answer"), F.col("sources"))).alias("n_unsupported"))


_SHOWN = "CASE WHEN abs(v - round(v)) < 1e-9 THEN format('{:,}', CAST(round(v) AS BIGINT)) WHEN abs(v) >= 1 THEN rtrim(rtrim(format('{:,.2f}', v), '0'), '.') ELSE rtrim(format('{:.4f}', v), '0') END"


@query(f"""SELECT o_orderkey, 'up ' || {_SHOWN} || '% or [calculation failed: ' || p || ' / 0]' AS text, 2 AS n_calcs
FROM (SELECT o_orderkey, printf('%.2f', o_totalprice) AS p, (CAST(printf('%.2f', o_totalprice) AS DOUBLE) - 100) / 100 * 100 AS v FROM orders)""")
def calc_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Calculations written into an answer for each order, evaluated without eval() in an Arrow function."""
    import pandas as pd

    def run(batches):
        for b in batches:
            done = [N.calculated(x) for x in b["answer"]]
            yield pd.DataFrame({"o_orderkey": b["o_orderkey"], "text": [t for t, _ in done], "n_calcs": [len(c) for _, c in done]})

    answer = F.format_string("up <calc>(%.2f - 100) / 100 * 100</calc>%% or <calc>%.2f / 0</calc>", "o_totalprice", "o_totalprice")
    rows = table(spark, sf, "orders").select("o_orderkey", answer.alias("answer"))
    return rows.mapInPandas(run, "o_orderkey bigint, text string, n_calcs bigint")
