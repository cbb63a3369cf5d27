"""S-8, S-9, S-10: file sources -- corpus JSONL, adapter weight JSON and
the binary artifact audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.half import to_dtype
from ..functions import constants as C
from ..functions.plan import fence
from ..sinks.writers import NESTED_SCHEMA


def read_corpus_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """S-8: nested corpus JSONL with a fixed schema.  ``strict`` fails on a
    malformed line (the splitter); otherwise malformed lines are skipped (the
    converter) -- ``malformed_lines`` counts them."""
    if strict:
        return spark.read.schema(NESTED_SCHEMA).option("mode", "FAILFAST").json(path)
    return _parsed(spark, path).filter(F.col("j._corrupt").isNull()).select(*[F.col(f"j.{f.name}").alias(f.name) for f in NESTED_SCHEMA.fields])


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines, and malformed lines among them, per file."""
    return _parsed(spark, path).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("lines"), F.count("j._corrupt").alias("malformed"))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*NESTED_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), parsed.alias("j"))


ADAPTER_FILE = T.StructType([
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("state_dict", T.MapType(T.StringType(), T.StringType())),
])
TENSOR_DICT = T.StructType([
    T.StructField("data", T.StringType()),
    T.StructField("values", T.StringType()),
    T.StructField("shape", T.ArrayType(T.LongType())),
    T.StructField("dtype", T.StringType()),
])


def _numbers(raw):
    """A JSON list of numbers, 1-D or 2-D, as array<double> (row-major)."""
    two_d = F.from_json(raw, T.ArrayType(T.ArrayType(T.DoubleType())))
    one_d = F.from_json(raw, T.ArrayType(T.DoubleType()))
    return F.when(F.ltrim(raw).startswith("[["), F.flatten(two_d)).otherwise(one_d)


def _adapter_lines(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """``adapter, metadata, state_dict`` of each adapter document; the adapter is
    ``metadata.name`` when present, else the file stem."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    raw = spark.read.schema(ADAPTER_FILE).option("multiLine", multi_line).json(path)
    return raw.select(F.coalesce(F.col("metadata")["name"], stem).alias("adapter"), "metadata", "state_dict")


def read_adapter_tensors(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S-9, a row for each tensor: ``adapter, tensor_key, dtype, values, shape, shape_ok``.

    A tensor entry is a list, or a dict with ``data`` or ``values`` plus optional
    ``shape`` and ``dtype``.  ``shape_ok`` is false where the declared shape does
    not hold the number of values (or has none to hold); without a shape it is true."""
    raw = _adapter_lines(spark, path, multi_line).select("adapter", F.explode("state_dict").alias("tensor_key", "entry"))
    d = F.from_json(F.col("entry"), TENSOR_DICT)
    is_dict = F.ltrim(F.col("entry")).startswith("{")
    body = F.when(is_dict, F.coalesce(d["data"], d["values"])).otherwise(F.col("entry"))
    dtype = F.when(is_dict, F.coalesce(d["dtype"], F.lit("float32"))).otherwise(F.lit("float32"))
    rows = fence(raw.select("adapter", "tensor_key", dtype.alias("dtype"), _numbers(body).alias("values"), F.when(is_dict, d["shape"]).alias("shape")))
    holds = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    fits = F.col("shape").isNull() | F.coalesce(holds == F.size("values"), F.lit(False))
    return rows.withColumn("shape_ok", F.col("values").isNotNull() & fits)


def read_adapter_json(spark: SparkSession, path: str, multi_line: bool = True, strict: bool = False) -> DataFrame:
    """S-9: adapter weight files (one JSON document per file, or per line with
    ``multi_line=False``) to the long table (adapter, tensor_key, pos, value,
    dtype).  Half-precision tensors hold their rounded values.  A tensor whose
    shape does not hold its values ends a ``strict`` read and is left out of
    another (``read_adapter_tensors`` lists it)."""
    tensors = read_adapter_tensors(spark, path, multi_line)
    if strict:
        why = F.concat(F.lit("shape of "), "adapter", F.lit("/"), "tensor_key", F.lit(" does not hold its values"))
        tensors = tensors.withColumn("values", F.when(F.col("shape_ok"), F.col("values")).otherwise(F.raise_error(why).cast("array<double>")))
    else:
        tensors = tensors.filter("shape_ok")
    out = tensors.select("adapter", "tensor_key", "dtype", F.posexplode("values").alias("pos", "value"))
    return out.select("adapter", "tensor_key", F.col("pos").cast("long").alias("pos"), to_dtype(F.col("value"), F.col("dtype")).alias("value"), "dtype")


def read_adapter_configs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S-9: each adapter's configuration: its metadata, and the defaults for the keys that it lacks
    (a key that is there keeps its value, null included)."""
    have = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    pairs = [x for k, v in C.ADAPTER_DEFAULTS.items() for x in (F.lit(k), F.lit(v))]
    missing = F.map_filter(F.create_map(*pairs), lambda k, _: ~F.map_contains_key(have, k))
    return _adapter_lines(spark, path, multi_line).select("adapter", F.map_concat(have, missing).alias("config"))


ARTIFACT_IDS = 1024


def write_artifacts(vectors: DataFrame, path: str) -> None:
    """One small file per ``ARTIFACT_IDS`` ids: eight bytes (little-endian) that
    declare the length of the JSON text behind them.  Every fifth declares more
    than there is."""
    n = F.floor(F.col("vec_id") / ARTIFACT_IDS).cast("long")
    rows = vectors.groupBy(n.alias("artifact")).agg(F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct(F.col("artifact").alias("part"), "n"))
    declared = F.when(F.pmod("artifact", F.lit(5)) == 0, F.lit(120)).otherwise(F.length(body))
    header = F.concat(F.char(declared), F.lit("\x00" * 7))
    rows.select("artifact", F.concat(header, body).alias("value")).write.partitionBy("artifact").text(path)


def artifact_audit(spark: SparkSession, path_glob: str) -> DataFrame:
    """S-10: size and declared header length of each artifact: the first 8
    bytes read as a little-endian unsigned integer; corrupt when the header
    claims more bytes than the file has.  The binary source hands whole files
    to a task, so it is meant for artifact folders, not table data."""
    files = spark.read.format("binaryFile").load(path_glob)
    hx = F.hex(F.substring(F.col("content"), 1, 8))
    le = F.concat(*[F.substring(hx, 2 * i + 1, 2) for i in range(7, -1, -1)])
    header = F.conv(le, 16, 10).cast("decimal(20,0)")
    return files.select(
        "path",
        F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"),
        F.col("length").alias("size"),
        F.when(F.col("length") >= 8, header).cast("long").alias("header_len"),
    ).withColumn("corrupt", F.coalesce(F.col("header_len") > F.col("size"), F.lit(True)))
