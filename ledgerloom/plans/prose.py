"""Registered query: the numbers of all documents' lines located in HTML made of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import prose
from ledgerloom.plans.registry import Registry, shared, table

registry = Registry()
query = registry.query

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) AS t, 3 + i + i // 7 AS node, CAST(1 + (i // 7) % 3 AS VARCHAR) AS code FROM l),
e AS (SELECT doc_id, node, t, code FROM n WHERE t <> '' UNION ALL SELECT doc_id, node - 1, 'Item ' || code || '. Part', code FROM n WHERE i % 7 = 0),
s AS (SELECT *, 1 + coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
f AS (SELECT doc_id, array_to_string(list(t ORDER BY node), ' ') AS page FROM e GROUP BY 1),
w AS (SELECT doc_id, i, string_split(t, ' ') AS w FROM n), k AS (SELECT *, list_position(list_transform(w, lambda x: regexp_matches(x, '[0-9]')), true) AS k FROM w),
c AS (SELECT doc_id, i, w[k] AS token, list_transform(w[greatest(1, k - 8):k - 1], lambda x, j: CASE WHEN i % 4 = 3 OR i % 4 = 1 AND j = 1 THEN 'zzz' ELSE x END) AS b, list_transform(w[k + 1:k + 8], lambda x: CASE WHEN i % 4 = 2 THEN 'qqq' ELSE x END) AS a FROM k WHERE k > 0),
p AS (SELECT doc_id, i, token, x.lv AS lv, array_to_string(b[-x.m:] || [token] || a[1:x.r], ' ') AS phrase FROM c, (VALUES (0, 8, 8), (1, 4, 4)) x(lv, m, r) UNION ALL
SELECT doc_id, i, token, 2, array_to_string(b[-4:] || [token], ' ') FROM c UNION ALL SELECT doc_id, i, token, 3, array_to_string([token] || a[1:4], ' ') FROM c),
o AS (SELECT doc_id, i, lv, phrase, string_split(page, phrase) AS parts FROM p JOIN f USING (doc_id) WHERE length(phrase) >= length(token) + 8 AND contains(page, phrase) QUALIFY lv = min(lv) OVER (PARTITION BY doc_id, i)),
q AS (SELECT doc_id, i, length(phrase) AS len, phrase, parts, unnest(range(1, len(parts))) AS j FROM o), z AS (SELECT doc_id, i, len, CAST(list_sum(list_transform(parts[1:j], lambda x: length(x))) AS BIGINT) + (j - 1) * len + 1 AS pos FROM q),
h AS (SELECT z.doc_id, z.i, min(pos) AS pos, CASE WHEN x.node = y.node THEN x.node ELSE 1 END AS node, CASE WHEN x.node = y.node THEN x.code WHEN length(page) < 150 THEN '1' END AS code FROM z
JOIN s x ON x.doc_id = z.doc_id AND z.pos BETWEEN x.start AND x.start + length(x.t) JOIN s y ON y.doc_id = z.doc_id AND z.pos + z.len - 1 BETWEEN y.start AND y.start + length(y.t) - 1 JOIN f ON f.doc_id = z.doc_id GROUP BY ALL),
g AS (SELECT *, coalesce(code = CAST(1 + i % 3 AS VARCHAR), false) AS fits, row_number() OVER (PARTITION BY doc_id, i ORDER BY pos, node) AS r FROM h),
v AS (SELECT * FROM g QUALIFY fits = bool_or(fits) OVER (PARTITION BY doc_id, i))
SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(node AS INTEGER) AS node, count(*) OVER (PARTITION BY doc_id, i) = 1 AS is_unique FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY r) = 1""")
def located_prose(spark: SparkSession, sf: str) -> DataFrame:
    """The first number of each line, asked for with the words around it, some of them changed, and an Item."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = lambda i: F.concat(F.lit("<p>Item "), (1 + F.floor(i / 7) % 3).cast("string"), F.lit(". Part</p>"))
    body = F.transform("lines", lambda x, i: F.concat(F.when(i % 7 == 0, head(i)).otherwise(""), F.lit("<p>"), escaped(x), F.lit("</p>")))
    at = f"{shared(spark)}/places"
    prose.index(docs.select("doc_id", F.concat(F.lit("<html><body>"), F.array_join(body, ""), F.lit("</body></html>")).alias("content")), "doc_id").write.parquet(at)
    rows = docs.select("doc_id", F.posexplode("lines").alias("line", "t")).where(F.rlike("t", F.lit("[0-9]")))
    rows = rows.select("doc_id", "line", F.split(F.trim(F.regexp_replace("t", r"(?U)\s+", " ")), " ").alias("w"))
    rows = rows.withColumn("k", F.array_position(F.transform("w", lambda x: F.rlike(x, F.lit("[0-9]"))), True).cast("int"))
    first = F.greatest(F.col("k") - 8, F.lit(1))
    changed = lambda x, j: F.when((F.col("line") % 4 == 3) | ((F.col("line") % 4 == 1) & (j == 0)), "zzz").otherwise(x)
    before = F.transform(F.slice("w", first, F.col("k") - first), changed)
    after = F.transform(F.slice("w", F.col("k") + 1, F.lit(8)), lambda x: F.when(F.col("line") % 4 == 2, "qqq").otherwise(x))
    asked = rows.select(F.struct("doc_id", "line").alias("id"), "doc_id", F.get("w", F.col("k") - 1).alias("token"), F.array_join(before, " ").alias("before"), F.array_join(after, " ").alias("after"), (1 + F.col("line") % 3).cast("string").alias("item"))
    return prose.locate_prose(asked, spark.read.parquet(at), "doc_id", most=None).select("id.doc_id", "id.line", "node", "is_unique")
