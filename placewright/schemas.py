"""Record schemas."""
from pyspark.sql import types as T

_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
_L = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PHOTO = _struct(url=_S, width=_I, height=_I, alt_text=_S)
EVENT = _struct(id=_S, title=_S, desc=_S, start=_TS, end=_TS, time_str=_S, venue=_S, area=_S, address=_S, image=_S, url=_S,
                price_min=_D, categories=_L, tags=_L, source=_S, fetched_at=_TS, attrs=T.MapType(_S, T.BooleanType()),
                desc_full=_S, raw_html_ref=_S, city=_S)
PLACE = _struct(id=_S, name=_S, city=_S, area=_S, address=_S, lat=_D, lon=_D, url=_S, image_url=_S, description=_S, cuisine=_S,
                atmosphere=_S, price_level=_I, rating=_D, popularity=_D, quality_score=_D, tags=_L, flags=_L, source=_S,
                source_url=_S, embedding=T.ArrayType(T.FloatType()), metadata=T.MapType(_S, _S), updated_at=_TS)
CURATION_PLACE = _struct(seq=T.LongType(), id=_S, name=_S, city=_S, domain=_S, url=_S, description=_S, address=_S, geo_lat=_D, geo_lng=_D,
                         tags=_L, flags=_L, photos=T.ArrayType(PHOTO), image_url=_S, phone=_S, email=_S, website=_S, hours=_S,
                         price_level=_S, rating=_D, last_updated=_S)
CATALOGUE_PLACE = _struct(id=_S, name=_S, description=_S, city=_S, address=_S, tags=_L, flags=_L, typical_time=_S, source=_S, rating=_D, price_range=_S)
FACET_ROW = _struct(city=_S, day=T.DateType(), kind=_S, key=_S, id=_S)
INGEST_LOG = _struct(ts=_TS, source=_S, count=T.LongType(), ok=T.BooleanType(), note=_S)
TAG_DIM = _struct(category=_S, level=_S, priority=_I, description=_S, ord=_I)
SYNONYM_DIM = _struct(synonym=_S, language=_S, category=_S, ord=_I)
AREA_DIM = _struct(area=_S, synonym=_S, ord=_I)
