"""File sources and sinks: JSON lines, JSON documents, CSV, text, YAML, metric tables, layout annotations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) holds anything, on any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; a missing path is the empty relation, a malformed line an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, errors(error, line)) of a JSON-lines path; lines that aren't objects are told from broken ones.

    A missing path gives the one error ``missing_jsonl``.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([("missing_jsonl", None)], "error string, line string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.withColumn("_row", F.from_json("value", f"{schema}, _corrupt string", options))
    is_object = F.ltrim("value").startswith("{")
    bad = F.col("_row._corrupt").isNotNull() | ~is_object | F.col("_row").isNull()
    names = [f.name for f in StructType.fromDDL(schema).fields] if hasattr(StructType, "fromDDL") else []
    good = parsed.filter(~bad).select([F.col(f"_row.{n}") for n in names] if names else "_row.*")
    good = good.drop("_corrupt")
    errors = parsed.filter(bad).select(F.when(is_object, "json_error").otherwise("not_object").alias("error"), F.col("value").alias("line"))
    return good, errors


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Object lines with keys in order; the output committer makes the write atomic."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "overwrite").json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str, default: DataFrame | None = None) -> DataFrame:
    """A whole-file JSON document; the default (or nothing) where it is missing."""
    if not exists(spark, path):
        return default if default is not None else spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def read_yaml(text: str) -> dict[str, Any]:
    """A configuration; an empty text is an empty one."""
    import yaml

    return yaml.safe_load(text) or {}


def write_json_document(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Each row as one JSON document; the folder is replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    """A column's lines as text files, null as an empty line."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headed CSV with every cell a string; a missing path is the empty relation, a missing column null."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], append: bool = False) -> None:
    """Fixed columns in order; a column the rows lack is an empty cell."""
    kept = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*kept).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def split_failures(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with the time they failed."""
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed).withColumn("failed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


#: For each canonical metric column the names under which files have it, best first.
ALIASES = {
    "page_id": ("page_id", "image_id", "imageId", "image-id"), "pipeline": ("pipeline", "Pipeline"), "condition": ("condition", "Condition"),
    "config_id": ("config_id", "configId", "config-id"), "probe_type": ("probe_type", "probeType", "probe-type"), "target_strategy": ("target_strategy", "targetStrategy", "target-strategy"),
    "TOR": ("TOR", "tor"), "CER_matched_mean": ("CER_matched_mean", "cer_matched_mean", "CER-matched-mean"), "delta_CER": ("delta_CER", "deltaCER", "delta-CER", "Δ_CER"),
    "B_SLR": ("B_SLR", "B-SLR", "b_slr", "BSLR", "B_slr"), "SLR_miss": ("SLR_miss", "slr_miss", "SLR-miss"), "SLR_topo": ("SLR_topo", "slr_topo", "SLR-topo"), "B_SLR_per_TOR": (),
}
#: Words in the names of metric files, and the condition of a config.
KEYWORDS, CONDITION_OF_CONFIG = ("phase", "anchor", "policy", "ppstructure", "global", "parser_metric"), {"A03": "structural_probe", "A08": "large_area_erasure"}


def unify_metrics(df: DataFrame, source: Column) -> DataFrame:
    """A metric file's rows on the canonical columns, with the file as ``source_file``.

    Of a column's names the first present wins; pipeline and condition come
    from the file's name and the config where the file has none.
    """
    pipeline = F.when(F.contains(F.lower(source), F.lit("ppstructure")), "ppstructure").otherwise("mineru")
    out = {}
    for column, names in ALIASES.items():
        present = next((n for n in names if n in df.columns), None)
        out[column] = F.col(present).cast("string") if present else F.lit(None).cast("string")
    condition = F.create_map(*[F.lit(x) for kv in CONDITION_OF_CONFIG.items() for x in kv])
    out["pipeline"] = F.coalesce(F.nullif(out["pipeline"], F.lit("")), pipeline)
    out["condition"] = F.coalesce(F.nullif(out["condition"], F.lit("")), F.try_element_at(condition, F.upper(F.trim(out["config_id"]))), F.lit(""))
    number = lambda c: out[c].try_cast("double")
    out["B_SLR_per_TOR"] = F.try_divide(number("B_SLR"), number("TOR")).cast("string")
    return df.select(*[c.alias(n) for n, c in out.items()], source.alias("source_file"))


def files_by_header(spark: SparkSession, roots: list[str], keywords: tuple[str, ...]) -> dict[str, list[str]]:
    """Paths of the metric files by their first line; the driver holds paths only, as any scan of them does."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(roots)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"), "value")
    named = lines.filter(F.lower(F.substring_index("path", "/", -1)).rlike("|".join(keywords)) & ~F.contains("path", F.lit(".ipynb_checkpoints")))
    heads = named.groupBy("path").agg(F.min_by("value", "at").alias("header")).groupBy("header").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return {r.header: r.paths for r in heads.collect()}


def load_metrics(spark: SparkSession, roots: list[str], keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """All CSV files under the roots whose name has a keyword (editor checkpoints aside), unified: one scan for each kind of header."""
    roots = [r for r in roots if exists(spark, r)]
    out = None
    for header, paths in sorted(files_by_header(spark, roots, keywords).items()) if roots else ():
        rows = spark.read.option("header", True).csv(paths).withColumn("_file", F.col("_metadata.file_name"))
        part = unify_metrics(rows, F.col("_file"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*ALIASES, "source_file")))


COCO = "images array<struct<id:long,file_name:string,doc_category:string>>, annotations array<struct<image_id:long,category_id:int,bbox:array<double>,area:double>>, categories array<struct<id:int,name:string>>"
#: Category names of the two layout sets.
PUBLAYNET = {1: "Text", 2: "Title", 3: "List", 4: "Table", 5: "Figure"}
DOCLAYNET = {1: "Caption", 2: "Footnote", 3: "Formula", 4: "List-item", 5: "Page-footer", 6: "Page-header", 7: "Picture", 8: "Section-header", 9: "Table", 10: "Text", 11: "Title"}


def layout_annotations(doc: DataFrame, names: dict[int, str]) -> DataFrame:
    """(image_id, file_name, doc_category, category, bbox in corners, area) of COCO documents.

    Names in the file win over ``names``; an unknown id is its own name; area
    defaults to width times height. Images without annotations keep a row
    with null category.
    """
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", F.coalesce("i.doc_category", F.lit("unknown")).alias("doc_category"))
    static = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    in_file = F.map_from_entries(F.transform(F.coalesce("categories", F.from_json(F.lit("[]"), "array<struct<id:int,name:string>>")), lambda c: F.struct(c.id, c["name"])))
    notes = doc.select(in_file.alias("m"), F.explode("annotations").alias("a"))
    b = [F.col("a.bbox")[i] for i in range(4)]
    category = F.coalesce(F.try_element_at("m", F.col("a.category_id")), F.try_element_at(static, F.col("a.category_id")), F.col("a.category_id").cast("string"))
    boxes = notes.select(F.col("a.image_id").alias("image_id"), category.alias("category"), F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]).alias("bbox"), F.coalesce("a.area", b[2] * b[3]).alias("area"))
    return images.join(boxes, "image_id", "left")


def selected_dataset(doc: DataFrame, images: DataFrame, names: dict[int, str], source: str) -> DataFrame:
    """One row an image of a selected set: size, annotations, block count, entropy and level.

    ``images(file_name, width, height)`` are those that could be read; others
    are dropped. An image without annotations is kept with none. A set
    without a readable image is an error when it is read.
    """
    from ..operators.masks import layout_entropy
    from ..operators.sampling import complexity

    notes = layout_annotations(doc, names)
    entropy = layout_entropy(notes.filter(F.col("category").isNotNull()), ["image_id"])
    blocks = notes.groupBy("image_id", "file_name", "doc_category").agg(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "bbox", "area"))).alias("annotations"))
    rows = blocks.join(images, "file_name").join(entropy, "image_id", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0))).withColumn("n_blocks", F.size("annotations"))
    return rows.withColumn("level", complexity(F.col("n_blocks"), F.col("entropy"))).withColumn("data_source", F.lit(source))


def listed(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, listed keys without a row)."""
    return df.join(ids, key, "left_semi"), ids.join(df, key, "left_anti")


def in_listed_order(df: DataFrame, ids: DataFrame, key: str, pos: str) -> DataFrame:
    return df.join(ids, key).orderBy(pos).drop(pos)


def missing_from_cache(wanted: DataFrame, cache: DataFrame, key: str, usable: Column) -> DataFrame:
    """Keys to compute: those the cache lacks, and those whose entry is unusable."""
    return wanted.join(cache.filter(usable).select(key), key, "left_anti")


def frozen_plans(doc: DataFrame) -> DataFrame:
    """(phase, config_id, image_id, step_no, step) of nested plan maps ``plans: map<phase, map<config, map<image, array<step>>>>``."""
    phases = doc.select(F.explode("plans").alias("phase", "c"))
    pages = phases.select("phase", F.explode("c").alias("config_id", "i")).select("phase", "config_id", F.explode("i").alias("image_id", "steps"))
    return pages.select("phase", "config_id", "image_id", F.posexplode("steps").alias("step_no", "step"))


def first_nonempty(*sources: DataFrame) -> DataFrame:
    """The first source with a row, else the last."""
    for s in sources[:-1]:
        if not s.isEmpty():
            return s
    return sources[-1]


def without_done(wanted: DataFrame, sink: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: the rows whose composite key the sink doesn't hold yet."""
    return wanted.join(sink.select(*keys), keys, "left_anti")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files; lines are numbered from 1 within each file, in file order."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    return text.select("file", F.row_number().over(Window.partitionBy("file").orderBy("block", "id")).alias("line_no"), "value")
