"""Units to questions, vectors and points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.scalar import questions_of, terms, uuid5
from lawloom.operators.models import Model, apply_model, chat_prompt
from lawloom.schemas import SETTINGS, SPARSE

#: Turns a series of texts into one of vectors; a model is loaded once a task.
Embedder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
SYSTEM = "You read acts and answer with JSON only."
PROMPT = 'Write %d questions that readers of this passage of an act might have and that it answers, as JSON with a list under "questions".\n\n%s'


def hash_embedder(dim: int = SETTINGS.dimension) -> Embedder:
    """A deterministic stand-in for a model: signed hashed counts of words and their trigrams, of unit length."""
    import zlib

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                if t is None or not t.strip():
                    out.append(None)
                    continue
                v = np.zeros(dim, np.float32)
                for w in t.lower().split():
                    for g in {w, *(w[i : i + 3] for i in range(len(w) - 2))}:
                        h = zlib.crc32(g.encode())
                        v[h % dim] += 1.0 if h >> 31 else -1.0
                n = float(np.linalg.norm(v))
                out.append((v / n if n else v).tolist())
            yield pd.Series(out, dtype=object)

    return embed


def embed(df: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    """Add the vector of a text column; blank texts have none."""
    f = F.pandas_udf(embedder, "array<float>")  # type: ignore[call-overload]
    return df.withColumn(out, f(F.col(text)))


def question_prompt(content: Column, n: int = SETTINGS.questions) -> Column:
    """What a language model is asked for a text."""
    return F.format_string(PROMPT, F.lit(n), content)


def template_answer(content: Column) -> Column:
    """A stand-in for the language model: a JSON answer with questions on the first words of the text."""
    lead = F.array_join(F.slice(F.split(content, " "), 1, 6), " ")
    return F.to_json(F.struct(F.array(*[F.concat(F.lit(q), lead, F.lit("?")) for q in ("Ce prevede: ", "Cui se aplică: ", "Când se aplică: ")]).alias("questions")))


def term_weights(docs: DataFrame, key: str, text: str, k1: float = SETTINGS.k1, b: float = SETTINGS.b, avgdl: float = SETTINGS.avgdl) -> DataFrame:
    """``key, term, tf, weight``: BM25 document weights, from exploded terms with partial aggregation."""
    t = docs.select(F.col(key).alias("key"), terms(F.col(text)).alias("ts")).select("key", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    tf = t.groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))
    return tf.select("key", "term", "tf", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("weight"))


def documents_with_terms(docs: DataFrame, text: str) -> Column:
    """The number of documents that have terms, as a scalar; cheaper than counting keys of the index."""
    return docs.select(F.count(F.when(F.size(terms(F.col(text))) > 0, 1)).alias("n")).scalar()


def inverse_frequencies(weights: DataFrame, n: Column | None = None) -> DataFrame:
    """``term, df, idf`` over the documents that have terms, of which ``n`` is the number if it is known."""
    if n is None:
        n = weights.select(F.countDistinct("key").alias("n")).scalar()
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_vectors(weights: DataFrame) -> DataFrame:
    """``key, sparse``: a term's index is the hash of the term itself, so no dictionary is kept."""
    pairs = F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("i"), F.col("weight").alias("w"))))
    return weights.groupBy("key").agg(pairs.alias("p")).select("key", F.struct(F.col("p.i").alias("indices"), F.col("p.w").alias("values")).alias("sparse"))


def asked_answers(units: DataFrame, chat: Model, most: int = SETTINGS.questions) -> DataFrame:
    """Units with the ``answer`` of a chat model that is asked for questions on their content; null where it fails."""
    prompt = chat_prompt(SYSTEM, question_prompt(F.col("content"), most))
    return apply_model(units.withColumn("prompt", prompt), "prompt", "answer", chat, "string").drop("prompt")


def enrich(units: DataFrame, embedder: Embedder, answer: Callable[[Column], Column] = template_answer, most: int = SETTINGS.questions, chat: Model | None = None) -> DataFrame:
    """Questions and vectors of units; chapters and sections have no questions and no sparse vectors.

    Questions without a vector are left out together with it, so texts and vectors stay side by side. Headers are split
    off before the question stage, as a conditional would run it for them too. Answers come from an expression, or from
    a chat model if there is one; an answer that fails or can't be read gives no questions.
    """
    header = F.col("unit_type").isin("chapter", "section")
    body = units.where(~F.coalesce(header, F.lit(False)))
    body = body.withColumn("answer", answer(F.col("content"))) if chat is None else asked_answers(body, chat, most)
    body = body.withColumn("hypothetical_questions", questions_of(F.col("answer"), most)).drop("answer")
    heads = units.where(header).withColumn("hypothetical_questions", F.array().cast("array<string>"))
    every = embed(body.unionByName(heads), "content", "content_vector", embedder)
    asked = embed(body.select("id", F.posexplode("hypothetical_questions").alias("n", "q")), "q", "v", embedder).where(F.col("v").isNotNull())
    text = F.concat("id", F.lit(" "), "n")
    sparse_q = sparse_vectors(term_weights(asked.select(text.alias("key"), "q"), "key", "q"))
    asked = asked.withColumn("key", text).join(sparse_q, "key", "left")
    listed = F.array_sort(F.collect_list(F.struct("n", "q", "v", "sparse")))
    asked = asked.groupBy("id").agg(listed.alias("l")).select("id", F.col("l.q").alias("qs"), F.col("l.v").alias("question_vectors"), F.col("l.sparse").alias("question_sparse_vectors"))
    sparse = sparse_vectors(term_weights(body, "id", "content")).select(F.col("key").alias("id"), F.col("sparse").alias("sparse_vector"))
    none = F.array().cast("array<array<float>>")
    out = every.drop("hypothetical_questions").join(asked, "id", "left").join(sparse, "id", "left")
    return out.withColumn("hypothetical_questions", F.coalesce("qs", F.array().cast("array<string>"))).withColumn("question_vectors", F.coalesce("question_vectors", none)).drop("qs")


def to_points(enriched: DataFrame) -> DataFrame:
    """A content point per unit with a vector, and a point per question with one; sparse parts only if not empty."""
    def sparse(c: Column) -> Column:
        return F.when(F.size(c["indices"]) > 0, c)

    base = ("unit_id", "unit_type", "vector_type", "content", "question_text", "parent_id", "dense", "sparse")
    content = enriched.where(F.size("content_vector") > 0).select(
        uuid5(F.concat("id", F.lit("_content"))).alias("point_id"), F.col("id").alias("unit_id"), "unit_type", F.lit("content").alias("vector_type"), "content",
        F.lit(None).cast("string").alias("question_text"), "parent_id", F.col("content_vector").alias("dense"), sparse(F.col("sparse_vector")).alias("sparse"),
    )
    n = F.least(F.size("hypothetical_questions"), F.size("question_vectors"))
    zipped = F.arrays_zip(F.slice("hypothetical_questions", F.lit(1), n).alias("q"), F.slice("question_vectors", F.lit(1), n).alias("v"), F.coalesce("question_sparse_vectors", F.array().cast(f"array<{SPARSE}>")).alias("s"))
    asked = enriched.where(n > 0).select("id", "unit_type", "parent_id", F.posexplode(zipped).alias("n", "z")).where(F.col("z.v").isNotNull())
    questions = asked.select(
        uuid5(F.concat("id", F.lit("_question_"), "n")).alias("point_id"), F.col("id").alias("unit_id"), "unit_type", F.lit("question").alias("vector_type"), F.lit(None).cast("string").alias("content"),
        F.col("z.q").alias("question_text"), "parent_id", F.col("z.v").alias("dense"), sparse(F.col("z.s")).alias("sparse"),
    )
    return content.unionByName(questions).select("point_id", *base)
