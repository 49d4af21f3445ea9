"""Schemas of the tables that operators exchange and the store keeps."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

# What the parser reads from one post table, before any field is worked out.
POST_NODES = _struct(
    ord=_I,
    user_link_strong=_S,
    has_user_link_strong=_B,
    any_strong=_S,
    user_href=_S,
    avatar_src=_S,
    infos=T.ArrayType(_S),
    sign_text=_S,
    time_text=_S,
    has_content=_B,
    content_html=_S,
    content_md=_S,
    td_id=_S,
    read_id=_S,
    hash_href=_S,
)

AUTHOR = _struct(
    username=_S, uid=_S, avatar=_S, post_count=_I, register_date=_S, last_login=_S, signature=_S
)

POSTS = _struct(
    tid=_S, position=_L, page=_L, floor=_S, post_id=_S, post_time=_TS, author=AUTHOR, content_html=_S, content_md=_S
)
THREADS = _struct(
    tid=_S, title=_S, url=_S, forum=_S, total_floors=_L, last_position=_L, created_at=_TS
)
ASSETS = _struct(tid=_S, url=_S, local=_S, alt=_S, file_size=_L, downloaded=_B, seq=_L)
SHARES = _struct(
    tid=_S, url=_S, content_id=_S, local_dir=_S, n_files=_L, downloaded=_B, error=_S, seq=_L
)
# The files of a share, in blocks: lists have no bound.
SHARE_FILES = _struct(tid=_S, url=_S, block=_L, files=T.ArrayType(_S))
RULES = _struct(
    seq=_L, name=_S, value=_S, domain=_S, path=_S, expires=_TS, max_age=_I, secure=_B, http_only=_B, same_site=_S
)
