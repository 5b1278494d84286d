"""The fixed schemas of the data model. Identifiers are always strings; they are never inferred."""

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


S, L, D, FL, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.FloatType(), T.IntegerType(), T.BooleanType()

PASSAGES = _s(("docid", S, False), ("title", S, False), ("text", S, False))
TOPICS = _s(("split", S, False), ("query_id", S, False), ("query_text", S, False))
QRELS = _s(("query_id", S, False), ("iteration", S, False), ("docid", S, False), ("relevance_grade", L, False))
RUN = _s(("split", S, False), ("query_id", S, False), ("docid", S, False), ("bm25_rank", L, False), ("bm25_score", D, False))
CANDIDATES = T.StructType([*RUN.fields, *_s(("relevance_grade", L, True), ("judgment", S, False), ("relevance", L, True), ("is_judged", B, False)).fields])
SCORES = _s(("query_id", S, False), ("docid", S, False), ("score", FL, False), ("tokens_before", I, False), ("tokens_after", I, False), ("truncated", B, False))
PAIRS = _s(("query_id", S, False), ("positive_docid", S, False), ("negative_docid", S, False), ("negative_source", S, False), ("negative_bm25_rank", I, False), ("pair_weight", FL, False))
