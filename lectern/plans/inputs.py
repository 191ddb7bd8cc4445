"""Domain inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents to a book.
BOOK = 400
#: A question is every vector whose id this divides.
EVERY = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_nodes(spark: SparkSession, sf_dir: str, dimensions: int | None = None) -> DataFrame:
    """embeddings as index rows: book and kind from the label."""
    kind = F.when(F.col("label") <= 5, "content").when(F.col("label") == 6, "summary").when(F.col("label") == 7, "glossary").when(F.col("label") == 8, "exercise").otherwise("figure")
    vector = F.slice("embedding", 1, dimensions) if dimensions else F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("b"), "label").alias("book_id"), kind.alias("kind"), "label", vector.alias("embedding"))


def questions(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "embedding", "label")


def book_of() -> F.Column:
    return F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / BOOK).cast("string"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as lines: a book is BOOK consecutive ids of a source, a page is a document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(book_of().alias("book_id"), "lang", F.col("doc_id").cast("int").alias("pdf_page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


#: The same as lines(), for DuckDB.
LINES = f"""
  select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, lang, cast(doc_id as integer) as pdf_page,
    unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as text
  from documents
"""
NODES = """
  select vec_id as id, 'b' || label as book_id, label, embedding::double[] as e,
    case when label <= 5 then 'content' when label = 6 then 'summary' when label = 7 then 'glossary' when label = 8 then 'exercise' else 'figure' end as kind
  from embeddings
"""
