"""The registered queries of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exactdedup, filteraudit, langid, merkle, mixing, packing, perplexity, pii, quality, simhash, tokencount, toxicity, urlgraph
from ledgerloom.llm.common import LOWER, UPPER, documents
from ledgerloom.plans.registry import spread


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    languages, prototypes = langid.train(docs.where(_remainder(5) != 0))
    out = langid.identify(docs, languages, prototypes)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.train(docs, labels.where(_remainder(4) != 2))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op4_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spread(documents(spark, sf_dir)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(documents(spark, sf_dir)))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return perplexity.classify(spread(documents(spark, sf_dir)), trusted).select("doc_id", "n_grams", "perplexity", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(spread(documents(spark, sf_dir)))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    return pii.find(docs, pii.train(pii.labelled(docs)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = {"text": merkle.lower_cased_thirds(F.col("doc_id"), F.col("text"))}
    return merkle.manifest(documents(spark, sf_dir), tampered=tampered)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_toxicity, op4_url_graph, op5_mixing, op6_exact_dedup, op7_simhash, op8_packing, op9_perplexity, op10_token_counts, op11_pii, op12_filter_audit, op13_merkle_manifest)}

_WORD = r"[^\x20\x09-\x0D]+"

_OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text IS NOT NULL AS given, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
i AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM i QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i AS p FROM r UNION ALL SELECT rid, i + 1 FROM r UNION ALL SELECT rid, i + 2 FROM r) GROUP BY 1),
f AS (SELECT w.rid, doc_id, lang, t, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid),
k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(words) AS w FROM w WHERE given) GROUP BY ALL),
e AS (SELECT lang, w, n FROM v WHERE lang IS NOT NULL UNION ALL SELECT NULL, w, sum(n) FROM v GROUP BY w),
top AS (SELECT lang, w, n FROM e QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 32),
tot AS (SELECT lang, sum(n) AS n FROM e GROUP BY 1),
rw AS (SELECT lang, w, n FROM top UNION ALL SELECT tot.lang, NULL, any_value(tot.n) - sum(top.n) FROM tot JOIN top ON tot.lang IS NOT DISTINCT FROM top.lang GROUP BY tot.lang),
cls AS (SELECT lang, w, n, length(regexp_replace(w, '\P{{Lu}}+', '', 'g')) AS c0, length(regexp_replace(w, '\P{{Nd}}+', '', 'g')) AS c1, length(regexp_replace(w, '[^.,;:?''"()-]+', '', 'g')) AS c2, length(regexp_replace(w, '[^#*$%&|<>]+', '', 'g')) AS c3, length(w) AS all_c FROM e),
rc AS (SELECT lang, unnest([0, 1, 2, 3, 4]) AS j, unnest([sum(n * c0), sum(n * c1), sum(n * c2), sum(n * c3), sum(n * (all_c - c0 - c1 - c2 - c3))])::DOUBLE AS q FROM cls GROUP BY 1),
dc AS (SELECT rid, lang, unnest([0, 1, 2, 3, 4]) AS j, unnest([c0, c1, c2, n_symbols, word_chars - c0 - c1 - c2 - n_symbols])::DOUBLE AS p FROM (SELECT *, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS c0, length(regexp_replace(t, '\P{{Nd}}+', '', 'g')) AS c1, length(regexp_replace(t, '[^.,;:?''"()-]+', '', 'g')) AS c2 FROM k WHERE n_words >= 50)),
cp AS (SELECT rid, p / sum(p) OVER (PARTITION BY rid) AS p, q / sum(q) OVER (PARTITION BY rid) AS q FROM dc JOIN rc ON dc.lang IS NOT DISTINCT FROM rc.lang AND dc.j = rc.j),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(words) AS w FROM k WHERE n_words >= 100 AND NOT base_failed) GROUP BY ALL),
pw AS (SELECT k.rid, rw.w, rw.n AS q, dw.n AS p, k.n_words FROM k JOIN rw ON k.lang IS NOT DISTINCT FROM rw.lang LEFT JOIN dw ON dw.rid = k.rid AND dw.w = rw.w WHERE k.n_words >= 100 AND NOT base_failed),
pq AS (SELECT rid, w, q, CASE WHEN w IS NULL THEN n_words - sum(coalesce(p, 0)) OVER (PARTITION BY rid) ELSE coalesce(p, 0) END AS p FROM pw),
wp AS (SELECT rid, p / sum(p) OVER (PARTITION BY rid) AS p, q / sum(q) OVER (PARTITION BY rid) AS q FROM pq),
js AS (SELECT rid, max(x) FILTER (kind = 0) AS cd, max(x) FILTER (kind = 1) AS wd FROM (SELECT rid, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS x
  FROM (SELECT rid, 0 AS kind, p, q FROM cp UNION ALL SELECT rid, 1, p, q FROM wp) GROUP BY ALL) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(cd, 0) > {quality.MAX_CLASS} OR coalesce(wd, 0) > {quality.MAX_WORDS}) AS kept
FROM k LEFT JOIN js ON js.rid = k.rid"""


def _op4_sql() -> str:
    """The rounds of both rankings, each a table of its own."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in sorted(urlgraph.RULES, key=lambda r: (-len(r.text), r.text)))
    blocked = ", ".join(f"'{r.text}'" for r in urlgraph.RULES if r.verdict == "block")
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '{urlgraph._URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    d = urlgraph.DAMPING
    href = urlgraph._HREF.replace("'", "''")
    parts = [
        f"p AS (SELECT page_id, {host('url')} AS host, coalesce(regexp_extract(url, '{urlgraph._URL}', 2), '') AS path, html FROM pages)",
        f"r AS (SELECT *, CASE {case} END AS rule FROM p)",
        f"h AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS x FROM p WHERE host <> '')",
        f"l AS (SELECT src, {host("CASE WHEN starts_with(x, '//') THEN ':' || x ELSE x END")} AS dst FROM h)",
        "n AS (SELECT DISTINCT host FROM (SELECT host FROM p UNION ALL SELECT dst FROM l) WHERE host <> '')",
        "c AS (SELECT string_split(host, '.') AS s FROM n)",
        "g AS (SELECT DISTINCT array_to_string(s[i:], '.') AS a, array_to_string(s[i + 1:], '.') AS b FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM c))",
        "w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM l WHERE dst <> '' AND src <> dst GROUP BY ALL)",
        "u AS (SELECT a AS src, b AS dst FROM g UNION SELECT b, a FROM g UNION SELECT src, dst FROM w)",
        "e AS (SELECT src, dst, coalesce(w, 1) AS w FROM u LEFT JOIN w USING (src, dst))",
        f"s AS (SELECT host, CASE WHEN rule IN ({blocked}) THEN 'b' ELSE 'a' END AS v, count(*) AS m FROM r WHERE host <> '' AND rule IS NOT NULL GROUP BY ALL)",
        "fa AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e)",
        "fb AS MATERIALIZED (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS p FROM e)",
    ]
    n = 65  # rounds that leave less than 0.0001 of the mass on its way
    for v in "ab":
        parts.append(f"{v}0 AS MATERIALIZED (SELECT host, m / sum(m) OVER () AS x FROM s WHERE v = '{v}')")
        for k in range(1, n + 1):
            parts.append(f"{v}{k} AS MATERIALIZED (SELECT host, sum(x) AS x FROM (SELECT dst AS host, {d} * x * p AS x FROM {v}{k - 1} JOIN f{v} ON host = src UNION ALL SELECT host, {1 - d} * x FROM {v}0) GROUP BY 1)")
    own = f"CASE WHEN coalesce(b{n}.x, 0) - coalesce(a{n}.x, 0) > coalesce(b{n}.x, 0) * 1e-9 THEN 'block' ELSE 'allow' END"
    return f"WITH {', '.join(parts)} SELECT page_id, r.host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE {own} END AS verdict FROM r LEFT JOIN a{n} ON r.host = a{n}.host LEFT JOIN b{n} ON r.host = b{n}.host"


_OP12_SQL = rf"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)}} AS fails FROM d LEFT JOIN k ON k.doc_id = d.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: fails[filter_order[i]])[1] AS gone, unnest([1, 2, 3, 4, 5]) AS step FROM f, o),
c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, count(*) FILTER (gone IS NULL OR gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
  count(*) FILTER (gone < step AND fails[filter_order[step]]) AS redundant, count(*) FILTER (fails[filter_order[step]] AND len(list_filter(map_values(fails), lambda y: y)) = 1) AS unique_fails,
  count(*) FILTER (gone = step AND good = 1) AS good_lost, count(*) FILTER (gone = step AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c"""


def _op13_sql(levels: int = 8) -> str:
    """The tree with each level a table of its own; `levels` of them hold 8 ** levels rows of a language."""
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: f"sha256({' || '.join(value(t if c == 'text' else c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))})"
    # CRC-32 bit by bit: a byte is taken in, then eight shifts.
    digits = "CAST(doc_id AS VARCHAR)"
    bits = f"list_prepend(4294967295, flatten(list_transform(range(1, length({digits}) + 1), lambda i: [CAST(ascii(substr({digits}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    bent = f"CASE WHEN coalesce({crc} % 3 = 0, false) THEN {lower} ELSE text END"
    parts = [
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, lang, {leaf('text')} AS leaf, {leaf('bent')} AS held FROM (SELECT *, {bent} AS bent FROM documents))",
        "a0 AS MATERIALIZED (SELECT rid, lang, leaf AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
    ]

    def up(t: str, g: str) -> None:
        for k in range(1, levels + 1):
            parts.append(f"{t}{k} AS MATERIALIZED (SELECT {g}, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 7) // 8 AS n FROM {t}{k - 1} GROUP BY {g}, i // 8)")

    def path(t: str, g: str, start: str, keep: str) -> str:
        """Every leaf with the siblings of all levels, and the folded hash, level by level."""
        names = []
        for k in range(levels):
            sib = f"(SELECT {g}, i // 8 AS p, list(h ORDER BY i) AS run FROM {t}{k} WHERE n > 1 GROUP BY ALL)"
            prev = start if k == 0 else names[-1]
            names.append(f"{t}p{k}")
            parts.append(
                f"{t}p{k} AS MATERIALIZED (SELECT {keep}, x.{g}, x.i // 8 AS i, x.proof || coalesce(array_to_string(run[:x.i % 8] || run[x.i % 8 + 2:], ''), '') AS proof, "
                f"CASE WHEN run IS NULL THEN held ELSE sha256(array_to_string(run[:x.i % 8] || [held] || run[x.i % 8 + 2:], '')) END AS held FROM {prev} x LEFT JOIN {sib} s ON s.{g} IS NOT DISTINCT FROM x.{g} AND s.p = x.i // 8)"
            )
        return names[-1]

    up("a", "lang")
    parts.append("s0 AS (SELECT *, '' AS proof FROM a0 JOIN (SELECT rid, doc_id, leaf, held FROM d) USING (rid))")
    low = path("a", "lang", "s0", "rid, doc_id, leaf")
    parts.append(f"b0 AS MATERIALIZED (SELECT 0 AS g, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a{levels})")
    up("b", "g")
    parts.append(f"t0 AS (SELECT rid, doc_id, leaf, x.lang, b.h AS subroot, 0 AS g, b.i AS i, x.proof, x.held FROM {low} x JOIN b0 b ON b.lang IS NOT DISTINCT FROM x.lang)")
    high = path("b", "g", "t0", "rid, doc_id, leaf, subroot")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(x.proof) AS proof_sha256, held AS folded_root, held = r.h AS verified FROM {high} x, b{levels} r"


ORACLE_SQL = {
    "op12_filter_audit": _OP12_SQL,
    "op13_merkle_manifest": _op13_sql(),
    "op2_quality_rules": _OP2_SQL,
    "op4_url_graph": _op4_sql(),
    "op5_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  1.0::DOUBLE + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST) AS k FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM c)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c),
f AS (SELECT min(k) AS k FROM l WHERE lv * w < cap),
t AS (SELECT source, source_size, CASE WHEN l.k >= (SELECT k FROM f) THEN (SELECT lv FROM l WHERE l.k = (SELECT k FROM f)) * w ELSE cap END AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate)
  THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op6_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
}
