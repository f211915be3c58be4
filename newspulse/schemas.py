"""Declared schemas of every source; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, DBL = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# One landed file per day: link, title, content, outlet label.
DAILY_ARTICLES = _struct(link=STR, title=STR, content=STR, medie=STR)

# News document: a list of articles with a nested source.
NEWS_ARTICLE = _struct(
    source=_struct(id=STR, name=STR), author=STR, title=STR, description=STR, url=STR,
    urlToImage=STR, publishedAt=STR, content=STR,
)
NEWS_ENVELOPE = _struct(status=STR, totalResults=LONG, articles=T.ArrayType(NEWS_ARTICLE))

# The flattened form, as stored in the news table.
NEWS_TABLE = _struct(
    source_id=STR, source_name=STR, author=STR, title=STR, description=STR, url=STR,
    urlToImage=STR, publishedAt=STR, content=STR,
)

NEWS_SOURCE = _struct(id=STR, name=STR, description=STR, url=STR, category=STR, language=STR, country=STR)
SOURCES_ENVELOPE = _struct(status=STR, sources=T.ArrayType(NEWS_SOURCE))

# Feed document: the list key may be missing altogether.
FEED_ITEM = _struct(
    title=STR, url=STR, time_published=STR, authors=T.ArrayType(STR), summary=STR, source=STR,
)
FEED_ENVELOPE = _struct(feed=T.ArrayType(FEED_ITEM), Information=STR, Note=STR)

PAGES = _struct(url=STR, html=STR)
RECTANGLES = _struct(id=LONG, label=STR, W=DBL, D=DBL)

SCORES = "struct<neg:double,neu:double,pos:double,compound:double>"
MENTIONS = "array<struct<pos:int,text:string,label:string>>"
