"""A question-answering engine over stored tables: index, named retrievers, decomposition, context, answers.

The tables are Parquet: children, parents and vectors by filing, and an inverted index. Models are functions; the defaults are
deterministic: a hashing embedder, a lexical reranker, a rule-based decomposer and an extractive answerer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.operators import audit
from ledgerloom.operators import retrieval as K
from ledgerloom.operators.bm25index import Bm25Index
from ledgerloom.operators.chunking import EMBED_KEYS, READ_KEYS, embed_text


@dataclass
class Models:
    """Pluggable parts. embed and rerank are Column functions; decompose and passage plain functions of a question."""

    embed: Callable[[Column], Column] = K.hash_embedding
    rerank: Callable[[Column, Column], Column] = K.lexical_score
    decompose: Callable[[str], list[str]] = audit.rule_based_split
    passage: Callable[[str], str] = staticmethod(lambda q: q)
    answer: Callable[[Column, Column], Column] = staticmethod(lambda question, context: F.concat(F.substring(context, 1, 400), F.lit(" [1]")))


@dataclass
class Settings:
    top_k: int = 10
    pool: str = "bm25_60"
    alpha: float = 0.3
    fused: int = 30
    read_k: int = 8
    budget: int = 5000
    max_parent: int = 1500


def build_index(nodes: DataFrame, path: str, models: Models | None = None) -> None:
    """Writes children, parents and vectors; a filing's partition is replaced as a whole, so a rerun changes nothing."""
    models = models or Models()
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filing_id").parquet(f"{path}/{name}")
    read = nodes.withColumn("embedded", embed_text(EMBED_KEYS)).withColumn("read", embed_text(READ_KEYS)).withColumn("read_tokens", T.token_count(F.col("read")))
    columns = ["filing_id", "node_id", "parent_id", "content_type", "heading_path", "text", "embedded", "read", "read_tokens"]
    put(read.where("node_type = 'child'").select(*columns), "children")
    put(read.where("node_type = 'parent'").select(*columns), "parents")
    put(read.where("node_type = 'child'").select("filing_id", "node_id", models.embed(F.col("embedded")).alias("v")), "vectors")
    _sparse(nodes.sparkSession, path).upsert(read.where("node_type = 'child'"), read.select("filing_id"), "filing_id", "node_id", "embedded")


def _sparse(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(spark, f"{path}/bm25", doc_type="string")


@dataclass
class Engine:
    spark: SparkSession
    path: str
    models: Models = field(default_factory=Models)
    settings: Settings = field(default_factory=Settings)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _filtered(self, name: str, where: Column | None) -> DataFrame:
        rows = self.table(name)
        return rows if where is None else rows.where(where)  # a filter on filing_id prunes partitions

    def bm25(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """From the stored index; where holds for what is ranked, a term's rarity is that of the whole index."""
        allowed = None if where is None else self._filtered("children", where).select(F.col("node_id").alias("doc"))
        return _sparse(self.spark, self.path).search(questions, k, "qid", "question", allowed).withColumnRenamed("doc", "node_id")

    def dense(self, questions: DataFrame, k: int, where: Column | None = None, vector: Column | None = None) -> DataFrame:
        q = questions.select("qid", (self.models.embed(F.col("question")) if vector is None else vector).alias("q"))
        return K.nearest(q, self._filtered("vectors", where), k, "qid", "node_id")

    def hyde_dense(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """Dense by the mean of the question's vector and that of a passage that might answer it."""
        passage = F.udf(self.models.passage, "string", useArrow=True).asNondeterministic()  # stays a column of its own
        rows = questions.withColumn("_passage", passage("question"))
        return self.dense(rows, k, where, K.mean_vector(self.models.embed(F.col("_passage")), self.models.embed(F.col("question"))))

    def hybrid(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        n = self.settings.fused
        return K.relative_fusion(self.dense(questions, n, where), self.bm25(questions, n, where), "qid", "node_id", k, self.settings.alpha)

    def rerank(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        lists = {name for name, _ in K.POOL_LISTS[self.settings.pool]}
        ranked = {name: {"bm25": self.bm25, "dense": self.dense, "hyde": self.hyde_dense}[name](questions, 60, where) for name in lists}
        pool = K.candidate_pool(self.settings.pool, ranked, "qid", "node_id").select("qid", "node_id")
        docs = self._filtered("children", where).select("node_id", F.col("embedded").alias("text"))
        return K.rerank(pool, questions.select("qid", F.col("question").alias("text")), docs, "qid", "node_id", k, self.models.rerank)

    def sub_questions(self, questions: DataFrame) -> DataFrame:
        """(qid, list_no, question): questions with a cue of several facts are split, the others stay; the split alone runs in Python."""
        cued = T.needs_decomposition(F.col("question"))
        split = F.udf(self.models.decompose, "array<string>", useArrow=True)
        subs = F.when(cued, split("question")).otherwise(F.array("question"))
        return questions.select("qid", F.posexplode(subs).alias("list_no", "question"))

    def decomposed(self, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """Each sub-question reranked for itself, and the lists interleaved."""
        subs = self.sub_questions(questions).withColumn("sub", F.concat_ws("#", "qid", F.col("list_no").cast("string")))
        ranked = self.rerank(subs.select(F.col("sub").alias("qid"), "question"), k, where).withColumnRenamed("qid", "sub")
        rows = ranked.join(subs.select("sub", "qid", "list_no"), "sub")
        return K.interleave(rows, "qid", "node_id", k)

    def retriever(self, name: str) -> Callable[..., DataFrame]:
        found = {"dense": self.dense, "bm25": self.bm25, "hybrid": self.hybrid, "rerank": self.rerank, "decomposed": self.decomposed, "hyde_dense": self.hyde_dense}
        if name not in found:
            raise ValueError(f"no such retriever: {name}")
        return found[name]

    def contexts(self, hits: DataFrame) -> DataFrame:
        """(qid, place, unit, read): parents, or children of large parents, within the budget."""
        children, parents = self.table("children"), self.table("parents")
        units = K.expand_to_parents(hits.select("qid", F.col("node_id").alias("child"), "rank"), children.select(F.col("node_id").alias("child"), F.col("parent_id").alias("parent"), F.col("read_tokens").alias("tokens")), parents.select(F.col("node_id").alias("parent"), F.col("read_tokens").alias("tokens")), "qid", self.settings.budget, self.settings.max_parent)
        texts = parents.select(F.col("node_id").alias("unit"), "read", "filing_id").unionByName(children.select(F.col("node_id").alias("unit"), "read", "filing_id"))
        return units.join(texts, "unit").select("qid", "place", "unit", "filing_id", "read")

    def answer(self, questions: DataFrame, decompose: bool = True) -> DataFrame:
        """(qid, question, answer, contexts, sources, unverified): retrieval, context, the model's text, and its numbers checked."""
        hits = (self.decomposed if decompose else self.rerank)(questions, self.settings.read_k)
        read = self.contexts(hits).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "unit", "filing_id", "read"))).alias("s"))
        rows = questions.join(read, "qid", "left").withColumn("s", F.coalesce("s", F.array().cast(read.schema["s"].dataType)))
        rows = rows.withColumn("contexts", F.transform("s", lambda x, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(":\n"), x["read"])))
        said = F.when(F.size("s") > 0, self.models.answer(F.col("question"), F.array_join("contexts", "\n\n"))).otherwise(F.lit(f"The sources {T.REFUSAL}."))
        calc = F.udf(lambda a: N.calculated(a)[0], "string", useArrow=True)
        rows = rows.withColumn("answer", said).withColumn("answer", F.when(F.contains("answer", F.lit("<calc>")), calc("answer")).otherwise(F.col("answer")))
        sources = F.transform("s", lambda x, i: F.struct((i + 1).alias("n"), x["unit"].alias("node_id"), x["filing_id"].alias("filing_id")))
        return rows.select("qid", "question", "answer", "contexts", sources.alias("sources"), N.unsupported(F.col("answer"), F.concat(F.array_join("contexts", "\n"), F.lit(" "), F.col("question"))).alias("unverified"), T.is_refusal(F.col("answer")).alias("refused"))


def cache_key(model: str, prompt: str, question: Column) -> Column:
    """Key of a stored model reply."""
    return F.sha1(F.concat_ws("\n", F.lit(model), F.lit(prompt), question))
