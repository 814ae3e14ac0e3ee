"""Schemas of the curated record and of its metadata row."""

from pyspark.sql import types as T

META = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("captions", T.ArrayType(T.StringType())), T.StructField("query", T.StringType()), T.StructField("unrelated_query", T.StringType()),
    T.StructField("file_name", T.StringType()), T.StructField("split", T.StringType()),
])
IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
RECORD = T.StructType([*META.fields[:6], T.StructField("image", IMAGE)])
