"""Declared row types shared by the sources and operators."""

from pyspark.sql import types as T

# One extracted unit. A location column that does not apply to a format is NULL.
DOCUMENTS = T.StructType([
    T.StructField("file_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("doc_seq", T.LongType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("section", T.StringType()),
    T.StructField("slide", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

CATALOGUE = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("categoria", "servicio", "paquete", "precio_usd", "modalidad", "plazo_entrega", "incluye")
])

QUERY_LOG = T.StructType([
    T.StructField("pregunta", T.StringType()),
    T.StructField("respuesta", T.StringType()),
    T.StructField("fuentes", T.ArrayType(T.StringType())),
    T.StructField("uso_rag", T.BooleanType()),
    T.StructField("duracion_s", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
])

FEEDBACK_LOG = T.StructType([
    T.StructField("pregunta", T.StringType()),
    T.StructField("respuesta", T.StringType()),
    T.StructField("feedback", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
