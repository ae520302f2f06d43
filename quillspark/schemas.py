"""The data model as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_IDS = T.ArrayType(_S)

SONG = _schema(song_id=_S, artist=_S, title=_S, text_raw=_S, source=_S, is_translation=_B)
CHUNK = _schema(chunk_id=_S, song_id=_S, section=_S, text=_S, position=_I, split_by=_S, force_split=_B)
REJECT = _schema(level=_S, reason=_S, song_id=_S, artist=_S, title=_S, position=_I, text_preview=_S, chunk_id=_S, embedder_name=_S)
EVAL_QUERY = _schema(query_id=_L, query=_S, relevant_song_ids=_IDS, query_type=_S, stratum=_S)
HIT = _schema(query_id=_L, song_id=_S, score=_D, best_chunk_id=_S, rank=_I)
THEME = _schema(theme_id=_S, text=_S, tier=_S, keep=_B, mark=_S, mark_seq=_L, recheck=_B, mark_before_recheck=_S)
JUDGEMENT = _schema(theme_id=_S, song_id=_S, grade=_I, dont_know=_B, at=_S)
REPLY = _schema(chunk_id=_S, attempt=_I, paraphrase=_S, description=_S)

# The strata and query types an evaluation set may name.
STRATA = ("main", "structure", "translation")
TIERS = ("short", "medium", "expanded")
