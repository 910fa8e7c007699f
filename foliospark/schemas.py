"""Schemas of the tables, layer by layer."""

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DateType(), T.LongType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The columns that tables of this kind have.
METADATA = _struct(arxiv_id=S, title=S, summary=S, authors=S, published=S, updated=S, primary_category=S, pdf_url=S)
CORPUS_CLEAN = _struct(arxiv_id=S, title_clean=S, abstract_clean=S, text_unit=S, authors=S, published=D, updated=D, primary_category=S, pdf_url=S)
CORPUS_WITH_SUMMARIES = T.StructType([*CORPUS_CLEAN.fields, T.StructField("summary", S)])
CORPUS_WITH_TOPICS = T.StructType([*CORPUS_WITH_SUMMARIES.fields, T.StructField("topic_id", T.IntegerType())])
EMBEDDINGS = _struct(arxiv_id=S, row_idx=L, embedded_text_col=S, embedding_model=S, embedding=T.ArrayType(T.FloatType(), False))
TOPICS = _struct(topic_id=T.IntegerType(), doc_count=L, keywords=S, text_col=S)
SOURCE = _struct(title=S, similarity=T.DoubleType(), pdf_url=S)
ANSWER = _struct(answer=S, score=T.DoubleType(), sources=T.ArrayType(SOURCE), context_preview=S, error=S)
