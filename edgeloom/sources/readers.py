"""Readers for the supported file layouts.

Only parquet and these text layouts are read; every reader returns tables in
the shapes of ``operators.matrix``. Schemas come from headers, never from
sampling the data.
"""

from __future__ import annotations

import fnmatch
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.operators.matrix import check_dense, from_columns, validate


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def header(spark: SparkSession, path: str, sep: str) -> list[str]:
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return [c.strip().strip('"') for c in line[0].split(sep)]


def _typed_csv(spark: SparkSession, path: str, sep: str, names: list[str], types: list[str],
               with_header: bool = True) -> DataFrame:
    schema = ", ".join(f"`c{k}` {t}" for k, t in enumerate(types))
    df = spark.read.csv(path, schema=schema, sep=sep, header=with_header, enforceSchema=True, mode="FAILFAST")
    return df.toDF(*[f"c{k}" for k in range(len(names))])


_FILE_BITS = 40  # a file may have 2**40 bytes, a table 2**22 files


def _file_key(uri: str) -> str:
    """A file's address without the ways in which its scheme's slashes may be written."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", uri)


def _row_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``row_id``: the file's number and the row's place in it, given where the row is read.

    A row's place is the first byte of its split plus its number in the split.
    A row has a byte or more, so places of different splits never meet. Nothing
    moves, and rows that are equal stay apart. Ids depend on the files and their
    splits, not on the order in which tasks run.
    """
    spark, columns = df.sparkSession, df.columns
    files = sorted({_file_key(f) for f in df.inputFiles()})  # what the listing on the driver holds anyway
    shared = spark.sparkContext.broadcast({f: k for k, f in enumerate(files)})

    def number(batches):
        number_of, at, key = shared.value, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, start = batch.column(0), np.asarray(batch.column(1))
            file = path.dictionary_encode() if not isinstance(path, pa.DictionaryArray) else path
            names = [number_of[_file_key(f)] for f in file.dictionary.to_pylist()]
            base = (np.asarray(names, np.int64)[np.asarray(file.indices)] << _FILE_BITS) + start
            cuts = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
            place = np.arange(len(base)) - np.repeat(cuts, np.diff(np.append(cuts, len(base))))
            if base[0] == key:
                place[: cuts[1] if len(cuts) > 1 else len(base)] += at
            key, at = base[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(base + place), *batch.columns[2:]], names=["row_id", *columns])

    placed = df.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return placed.mapInArrow(number, f"row_id BIGINT, {kinds}")


def variables_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "var_id INT, var_name STRING")


def read_expression_csv(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """``(samples, variables)`` from a CSV whose first column labels the samples.

    ``row_id`` is the row's place in its file (see ``_row_ids``): equal rows
    stay apart and the read moves nothing.
    """
    names = header(spark, path, sep)
    df = _typed_csv(spark, path, sep, names, ["string"] + ["double"] * (len(names) - 1))
    values = [f"c{k}" for k in range(1, len(names))]
    samples = from_columns(_row_ids(df), values, "row_id")
    return validate(samples, len(values)), variables_table(spark, names[1:])


def read_square_csv(spark: SparkSession, path: str, value: str = "value", sep: str = ",") -> tuple[DataFrame, int]:
    """``(edges, p)`` from a square matrix with a header row and no index column.

    Rows of such a file are identified by position only, so the file is read
    as one text split per row order: each row is matched to its line number
    within the file (p lines, size checked).
    """
    names = header(spark, path, sep)
    p = len(names)
    check_dense(p, "a square matrix file")
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split(F.regexp_replace("value", "\\r", ""), "\n")).alias("line", "text"))
    rows = lines.filter((F.col("line") > 0) & (F.trim("text") != "")).select(
        (F.col("line") - 1).alias("i"),
        F.transform(F.split("text", sep), lambda t: t.cast("double")).alias("x"))
    edges = rows.select("i", F.posexplode("x").alias("j", value)).filter("i < j")
    return edges, p


def read_npy(spark: SparkSession, path: str, value: str = "value") -> tuple[DataFrame, int]:
    """``(edges, p)`` from a saved square array (driver side, size checked)."""
    from edgeloom.operators.gram import matrix_edges

    m = np.load(path, allow_pickle=False)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError("the saved array must be square")
    return matrix_edges(spark, m.astype(float), value), m.shape[0]


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines as ``gene``."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).filter(F.col("gene") != "")


def read_gene_order(spark: SparkSession, path: str) -> DataFrame:
    """``var_id, var_name``: the position of each name among the non-blank lines."""
    text = spark.read.text(path, wholetext=True)
    names = F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return text.select(F.posexplode(names).alias("var_id", "var_name"))


def _first_existing(spark: SparkSession, candidates: list[str], what: str) -> str:
    for c in candidates:
        if exists(spark, c):
            return c
    raise FileNotFoundError(f"{what} not found; looked for {candidates}")


def _looks_numeric(text: str | None) -> bool:
    try:
        float(text)
        return True
    except (TypeError, ValueError):
        return False


def load_dream5(spark: SparkSession, data_dir: str, network: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(samples, variables, gold)`` of a network-inference challenge folder.

    Expression: tab-separated, either samples x genes, or genes x samples with
    the gene name in the first column (transposed). Gold: ``TF target label``
    (tabs) or ``from,to,weight`` (commas, positives only).
    """
    d = str(data_dir).rstrip("/")
    # fixed values: file layouts
    expr = _first_existing(spark, [
        f"{d}/net{network}_expression_data.tsv",
        f"{d}/net{network}_expression_data_avg.tsv",
        f"{d}/extracted/DREAM5_NetworkInferenceChallenge_AlternativeDataFormats/"
        f"net{network}/net{network}_expression_data_avg.tsv",
    ], "expression file")
    gold_path = _first_existing(spark, [
        f"{d}/DREAM5_NetworkInference_GoldStandard_Network{network}.tsv",
        f"{d}/in_silico_gold_standard.csv",
    ], "gold standard")
    names = header(spark, expr, "\t")
    first = spark.read.csv(expr, sep="\t", header=True).first()
    if first is not None and not _looks_numeric(first[0]):
        df = _typed_csv(spark, expr, "\t", names, ["string"] + ["double"] * (len(names) - 1))
        genes = [r[0] for r in df.select("c0").orderBy(F.monotonically_increasing_id()).collect()]
        variables = variables_table(spark, genes)
        # a gene's rows are told apart by their order, so a repeated name is two variables
        nth = df.withColumn("_nr", F.row_number().over(Window.partitionBy("c0").orderBy(F.monotonically_increasing_id())))
        known = variables.withColumn("_nr", F.row_number().over(Window.partitionBy("var_name").orderBy("var_id")))
        long = nth.join(known, (nth["c0"].eqNullSafe(known["var_name"])) & (nth["_nr"] == known["_nr"])).select(
            "var_id", F.posexplode(F.array(*[f"c{k}" for k in range(1, len(names))])).alias("row", "value"))
        entries = F.array_sort(F.collect_list(F.struct("var_id", "value")))
        samples = long.groupBy(F.col("row").cast("bigint").alias("row_id")).agg(entries.alias("e")).select(
            "row_id", F.transform("e", lambda e: e["value"]).alias("x"))
    else:
        df = _typed_csv(spark, expr, "\t", names, ["double"] * len(names))
        cols = [f"c{k}" for k in range(len(names))]
        samples = from_columns(_row_ids(df), cols, "row_id")
        variables = variables_table(spark, names)
    sep = "," if gold_path.endswith(".csv") else "\t"
    raw = spark.read.csv(gold_path, sep=sep, header=True)
    if "from" in raw.columns:
        gold = raw.select(F.col("from").alias("TF"), F.col("to").alias("target"), F.lit(1).alias("label"))
    else:
        gold = raw.select("TF", "target", F.col("label").cast("int").alias("label"))
    return samples, variables, gold


def load_sergio(spark: SparkSession, data_dir: str, dataset_id: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """``(long, edges, genes)`` of a simulated single-cell folder ``*DS{id}``.

    Cells of all files are concatenated; ``long`` is ``row_id`` (cell),
    ``var_id`` (gene), ``value``. The 1-based directed regulation list becomes
    undirected edges without self-loops.
    """
    folders = [f for f in list_dir(spark, str(data_dir)) if fnmatch.fnmatch(f.split("/")[-1], f"*DS{dataset_id}")]
    if not folders:
        raise FileNotFoundError(f"no folder *DS{dataset_id} in {data_dir}")
    files = [f for f in list_dir(spark, folders[0]) if fnmatch.fnmatch(f.split("/")[-1], "simulated_noNoise_*.csv")]
    if not files:
        raise FileNotFoundError(f"no simulated_noNoise_*.csv in {folders[0]}")
    offset, long = 0, None
    for f in files:  # a handful of files (one per cell type), each read in parallel
        names = header(spark, f, ",")
        df = _typed_csv(spark, f, ",", names, ["int"] + ["double"] * (len(names) - 1))
        part = df.select(
            F.col("c0").alias("_g"),
            F.posexplode(F.array(*[f"c{k}" for k in range(1, len(names))])).alias("_c", "value"),
        ).select((F.col("_c") + offset).cast("bigint").alias("row_id"), "_g", "value")
        offset += len(names) - 1
        long = part if long is None else long.unionByName(part)
    genes = _typed_csv(spark, files[0], ",", names, ["int"] + ["double"] * (len(names) - 1)).select(
        F.col("c0").alias("_g"))
    index = genes.withColumn("var_id", F.row_number().over(Window.orderBy("_g")) - 1)  # one row per gene
    p = genes.count()
    long = long.join(F.broadcast(index), "_g").select("row_id", "var_id", "value")
    grn = spark.read.csv(f"{folders[0]}/gt_GRN.csv", schema="s DOUBLE, t DOUBLE")
    src, tgt = F.col("s").cast("int") - 1, F.col("t").cast("int") - 1
    edges = grn.select(F.least(src, tgt).alias("i"), F.greatest(src, tgt).alias("j")).filter("i < j").distinct()
    return long, edges, p


def read_string_info(spark: SparkSession, path: str) -> DataFrame:
    """``protein, gene`` from a (gzipped) protein-info table."""
    df = spark.read.csv(path, sep="\t", header=True)
    df = df.toDF(*[c.lstrip("#").strip() for c in df.columns])
    return df.select(F.col("string_protein_id").alias("protein"), F.col("preferred_name").alias("gene"))


def read_string_edges(spark: SparkSession, path: str, info: DataFrame, threshold: int = 400) -> DataFrame:
    """Canonical ``gene_a < gene_b`` pairs with an experimental score of at least ``threshold``."""
    df = spark.read.csv(path, sep=" ", header=True)
    df = df.toDF(*[c.lstrip("#").strip() for c in df.columns])
    column = next((c for c in ("experiments", "experimental") if c in df.columns), None)
    if column is None:
        raise ValueError(f"no experimental score column among {df.columns}")
    a = info.select(F.col("protein").alias("protein1"), F.col("gene").alias("g1"))
    b = info.select(F.col("protein").alias("protein2"), F.col("gene").alias("g2"))
    return (
        df.filter(F.col(column).cast("int") >= threshold)
        .join(a, "protein1").join(b, "protein2").filter("g1 <> g2")
        .select(F.least("g1", "g2").alias("gene_a"), F.greatest("g1", "g2").alias("gene_b")).distinct()
    )


def from_anndata(layers: DataFrame, var: DataFrame, n_vars: int | None = None, layer: str | None = None,
                 genes: list[str] | None = None, use_hvg: bool = False, npn: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(samples, variables)`` from an annotated matrix held as tables.

    ``layers`` is ``layer, row_id, var_id, value`` without the zeros (layer
    NULL is the main matrix); ``var`` is ``var_id, var_name`` and optionally
    ``highly_variable``. Named genes win over the variability mask, which is
    ignored when absent.
    """
    from edgeloom.operators.preprocess import npn_shrinkage

    chosen = layers.filter(F.col("layer").isNull() if layer is None else F.col("layer") == layer)
    if layer is not None and chosen.isEmpty():
        raise KeyError(layer)
    spark = layers.sparkSession
    if genes is not None:
        wanted = spark.createDataFrame(list(enumerate(genes)), "pos INT, var_name STRING")
        missing = wanted.join(var, "var_name", "left_anti").orderBy("pos").collect()
        if missing:
            raise ValueError(f"gene names not found: {[r['var_name'] for r in missing]}")
        keep = wanted.join(var, "var_name").select("var_id", "var_name", "pos")
    else:
        kept = var.filter("highly_variable") if use_hvg and "highly_variable" in var.columns else var
        keep = kept.select("var_id", "var_name", (
            F.row_number().over(Window.orderBy("var_id")) - 1).alias("pos"))  # one row per variable
    variables = keep.select(F.col("pos").alias("var_id"), "var_name")
    p = n_vars if n_vars is not None and genes is None and not use_hvg else keep.count()
    rows = chosen.select("row_id").distinct()
    cells = chosen.join(keep.select("var_id", "pos"), "var_id").groupBy("row_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    zero = F.lit(0.0)
    samples = rows.join(cells, "row_id", "left").select("row_id", F.transform(
        F.sequence(F.lit(0), F.lit(p - 1)),
        lambda k: F.coalesce(F.try_element_at("m", k), zero)).alias("x"))
    return (npn_shrinkage(samples) if npn else samples), variables


def read_results(spark: SparkSession, paths: list[str], benchmark: str) -> DataFrame:
    """Result CSVs with ``benchmark`` and ``seed_offset`` (from the file name if absent).

    Files may have different columns, so each distinct header is one read.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(header(spark, path, ",")), []).append(path)
    out = None
    for names, files in groups.items():
        df = spark.read.csv(files, header=True)
        if "seed_offset" not in names:
            tag = F.regexp_extract(F.input_file_name(), r"_s(\d{2})_rep", 1)
            df = df.withColumn("seed_offset", F.when(tag != "", tag.cast("int")).otherwise(0))
        else:
            df = df.withColumn("seed_offset", F.col("seed_offset").cast("int"))
        df = df.withColumn("benchmark", F.lit(benchmark))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no result files")
    return out


def find_results(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """All ``{prefix}*.csv`` below ``root``."""
    found, todo = [], [root]
    while todo:
        folder = todo.pop()
        fs, p = _fs(spark, folder)
        if not fs.exists(p):
            continue
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if s.isDirectory():
                todo.append(s.getPath().toString())
            elif name.startswith(prefix) and name.endswith(".csv"):
                found.append(s.getPath().toString())
    return sorted(found)
