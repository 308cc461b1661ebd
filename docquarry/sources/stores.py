"""Sources and sinks: corpus files, question and decision files, and the engine's stores as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docquarry.functions import text as X
from docquarry.operators import ingest, search
from docquarry.plans.retrieve import Stores, build_children
from docquarry.session import stash

REGISTRY = "source string, code_name string, edition_year int"
QUESTIONS = "questions array<struct<id:string,type:string,question:string,expected:array<array<struct<source:string,section_id:string>>>,answer_contains:array<string>,note:string>>"
CHECKLIST = "id string, title string, description string, items array<struct<id:string,element:string,measured:struct<value:string,unit:string>,question:string,expected_outcome:string,expected_section:string,note:string>>"
DECISIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("item_id", "action", "outcome", "note")])


def corpus_files(spark: SparkSession, folder: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of a folder that the registry lists (path, source, suffix, code_name, edition_year), and those it doesn't."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("source"))
    files = files.withColumn("suffix", F.lower(F.concat(F.lit("."), F.element_at(F.split("source", r"\."), -1))))
    return files.join(registry, "source"), files.join(registry, "source", "left_anti")


def markdown_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files as page 1: source, page, text."""
    return spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.lit(1).alias("page"), F.col("value").alias("text"))


def page_kind(suffix):
    """pdf or markdown; any other suffix raises."""
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".md", ".markdown"), "markdown").otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: "), suffix)))


def pdf_pages(spark: SparkSession, paths: str | list[str], read_pages) -> DataFrame:
    """source, page, text of PDF files; read_pages(bytes) gives the texts of a file's pages (a PDF library's job)."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1], i, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(read_pages(c), 1)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "source string, page int, text string")


def load_pages(spark: SparkSession, folder: str, registry: DataFrame, read_pages=None) -> DataFrame:
    """source, page, text of a folder's files that the registry lists, each by its suffix; another suffix raises.

    read_pages(bytes) gives the texts of a PDF file's pages; without it PDF files raise too.
    """
    listed, _ = corpus_files(spark, folder, registry)
    kinds: dict[str, list[str]] = {}
    for r in listed.select("path", page_kind(F.col("suffix")).alias("kind")).orderBy("path").collect():  # the registry bounds them
        kinds.setdefault(r["kind"], []).append(r["path"])
    if "pdf" in kinds and read_pages is None:
        raise ValueError(f"no PDF reader for {kinds['pdf'][0]}")
    parts = [markdown_pages(spark, kinds["markdown"])] if "markdown" in kinds else []
    parts += [pdf_pages(spark, kinds["pdf"], read_pages)] if "pdf" in kinds else []
    out = spark.createDataFrame([], "source string, page int, text string")
    for part in parts:
        out = out.unionByName(part)
    return out


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path, multiLine=True).select(F.inline("questions"))


def checklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKLIST).json(path, multiLine=True).select(F.col("id").alias("checklist_id"), F.inline("items"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISIONS).json(path, multiLine=True)


def last_wins(parents: DataFrame, order: str = "position") -> DataFrame:
    """One row for each parent_id: the last one by `order`, where rows share an id."""
    if order not in parents.columns:
        return parents.dropDuplicates(["parent_id"])
    return parents.groupBy("parent_id").agg(F.max_by(F.struct(*(c for c in parents.columns if c != "parent_id")), order).alias("r")).select("parent_id", "r.*")


def _replace(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a table that df itself may read."""
    stash(df, "table").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_stores(parents: DataFrame, folder: str, embed=None) -> DataFrame:
    """Write the four stores of parents (parent_id, text, breadcrumb, searchable, ...); returns store and rows.

    docstore: all parents. sections and children: searchable ones with embeddings of breadcrumb and text, as far as embed() is
    given; rows whose text is unchanged keep the embedding they have, ids that are gone are deleted. bm25: postings, terms and size.
    """
    spark = parents.sparkSession
    docstore = _replace(last_wins(parents), f"{folder}/docstore")
    live = docstore.where("searchable")
    kids = build_children(docstore).join(live.select("parent_id", "breadcrumb"), "parent_id")
    kids = stash(kids.withColumn("index_text", ingest.index_text(F.col("breadcrumb"), F.col("text"))), "children")
    sections = live.select("parent_id", F.substring("text", 1, ingest.SECTION_PREFIX).alias("text"), ingest.index_text(F.col("breadcrumb"), F.col("text"), ingest.SECTION_PREFIX).alias("index_text"))
    for name, rows, ident in (("sections", sections, "parent_id"), ("children", kids, "child_id")):
        path = f"{folder}/{name}"
        if embed is not None:
            held = spark.read.parquet(path) if _exists(spark, path) else None
            if held is not None and "embedding" in held.columns:
                rows = upsert(held, rows, ident, "index_text", lambda df: embed(df, "index_text"))
            else:
                rows = embed(rows, "index_text")
        _replace(rows, path)
    index = search.build_index(spark.read.parquet(f"{folder}/children"), "child_id", X.tokenize(F.col("index_text"), True))
    for name in ("postings", "terms", "size"):
        _replace(getattr(index, name), f"{folder}/{name}")
    return counts(spark, folder)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """store and n of the four stores; that of bm25 are the indexed children."""
    tables = {"sections": "sections", "children": "children", "docstore": "docstore"}
    out = spark.read.parquet(f"{folder}/size").select(F.lit("bm25").alias("store"), F.col("n").cast("long").alias("n"))
    for store, name in tables.items():
        out = out.unionByName(spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(store).alias("store"), "n"))
    return out


def load_stores(spark: SparkSession, folder: str, embed=None, **options) -> Stores:
    """What write_stores() wrote, for retrieve(); options: of Stores."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    kids, sections = read("children"), read("sections")
    index = search.Index("child_id", read("postings"), read("terms"), read("size"))
    vectors = lambda df, ident: df.select(ident, "embedding") if "embedding" in df.columns else None
    return Stores(read("docstore"), kids.select("child_id", "parent_id", "child_index", "start_char", "text"), index, vectors(kids, "child_id"), vectors(sections, "parent_id"), embed, **options)


def export_docstore(parents: DataFrame, path: str) -> None:
    """A JSON line for each parent: parent_id, text and metadata."""
    rest = [c for c in parents.columns if c not in ("parent_id", "text")]
    last_wins(parents).select("parent_id", "text", F.struct(*rest).alias("metadata")).write.mode("overwrite").json(path)


def import_docstore(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What export_docstore() wrote; schema: of the metadata."""
    return spark.read.schema(f"parent_id string, text string, metadata struct<{schema}>").json(path).select("parent_id", "text", "metadata.*")


def upsert(stored: DataFrame, current: DataFrame, id_col: str, text_col: str, embed) -> DataFrame:
    """current with embeddings: unchanged ids keep theirs, embed(df) gives the others'; ids that are gone are left out."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    told = stash(ingest.upsert_diff(stored.withColumn("_h", digest), current.withColumn("_h", digest), id_col, "_h"), "diff")
    keep = current.join(told.where("action = 'keep'"), id_col, "left_semi").join(stored.select(id_col, "embedding"), id_col)
    return keep.unionByName(embed(current.join(told.where("action in ('insert', 'update')"), id_col, "left_semi")))
