"""Readers of catalogs, exports, ground truth, golden labels, reports and snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritide.functions.text import slug

#: Columns that may hold a KPI's question, in order of preference.
QUESTION_COLUMNS = ("question", "kpi_question", "definition", "description", "name")
EXPORT = "url string, content string, tier int, created_at string, date string"
POINTS = "name string, answer string, explanation string, definition string, output_variable string, sources string"


def pick_csv(names: list[str]) -> str | None:
    """The first name in order that holds "kpi", else the first of all."""
    ordered = sorted(names)
    return next((n for n in ordered if "kpi" in n.lower()), ordered[0] if ordered else None)


def scan_kpi_csv(spark: SparkSession, path: str) -> DataFrame:
    """(kpi_id, pillar, question, rubric) of a catalog; rows whose status is neither blank nor confirmed are left out.

    The id is the slug of the name and the row's number in the file, so the file must have a ``row`` column.
    """
    df = spark.read.csv(path, header=True, multiLine=True)
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    have = [c for c in QUESTION_COLUMNS if c in df.columns]
    ok = F.coalesce(F.lower(F.trim("status")), F.lit("")).isin("", "confirmed")
    levels = F.array(*(F.when(text(f"level_{i}").isNotNull(), F.concat(F.lit(f"{i}: "), text(f"level_{i}"))) for i in range(1, 6) if f"level_{i}" in df.columns))
    kpi_id = F.concat_ws("_", slug(F.coalesce("name", F.lit(""))), F.col("row"))
    return df.where(ok).select(kpi_id.alias("kpi_id"), "pillar", F.coalesce(*map(text, have)).alias("question"), F.array_compact(levels).alias("rubric"))


def padded_rubric(rubric: Column) -> Column:
    """Five levels; missing ones read "(no criteria defined)"."""
    return F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.coalesce(F.get(rubric, i - 1), F.concat(i.cast("string"), F.lit(": (no criteria defined)"))))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def iso_time(c: Column) -> Column:
    """ISO time; without an offset the fraction is dropped and +00:00 added."""
    zone = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zone, F.regexp_replace(c, "Z$", "+00:00")).otherwise(F.concat(F.regexp_replace(c, r"\.\d+$", ""), F.lit("+00:00")))


def scan_sources_export(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(source_id, url, content, tier, retrieved_at): trimmed, without empty rows, the first of equal URLs, at most ``cap``.

    The export is a JSON array with a ``pos`` field that keeps its order.
    """
    df = spark.read.schema(EXPORT + ", pos long").json(path, multiLine=False)
    df = df.withColumn("url", F.trim("url")).withColumn("content", F.trim("content")).where("url <> '' AND content <> ''")
    df = first_of_each(df, "url", "pos")
    df = df.select(
        F.substring(F.sha1("url"), 1, 8).alias("source_id"), "url", "content", F.coalesce("tier", F.lit(2)).alias("tier"),
        iso_time(F.coalesce("created_at", "date")).alias("retrieved_at"), "pos",
    )
    return (df.orderBy("pos").limit(cap) if cap else df).drop("pos")


def scan_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, answer, urls) of analyst points with a name; URLs lose trailing punctuation."""
    df = spark.read.schema(POINTS).json(path)
    urls = F.transform(F.regexp_extract_all("sources", F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;)]+$", ""))
    return df.where(F.trim("name") != "").select(F.trim("name").alias("name"), "answer", F.coalesce(urls, F.array().cast("array<string>")).alias("urls"))


def pick_column(df: DataFrame, *candidates: str) -> Column:
    """The first candidate column that the table has, else null."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(None))


def newest_first(df: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """``df`` with rank 1 for the newest row of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), tie)))


KPI = "kpi_id string, name string, pillar string, type string, question string, rubric array<string>, keywords array<string>, thresholds array<double>"
REPORT = "run_id string, timestamp string, company string, overall_score double"


def _yaml(spark: SparkSession, path: str) -> DataFrame:
    from veritide.sources.yaml_source import YamlSource

    spark.dataSource.register(YamlSource)
    return spark.read.format("yaml_docs").load(path)


def scan_kpi_yaml(spark: SparkSession, path: str, schema: str = KPI) -> DataFrame:
    """One row for each KPI of a YAML catalog (a list of mappings); an empty catalog gives none."""
    body = F.from_json("body", f"array<struct<{', '.join(f'{n}:{k}' for n, k in (c.strip().split(' ', 1) for c in _columns(schema)))}>>")
    return _yaml(spark, path).select(F.explode(body).alias("k")).select("k.*")


def _columns(schema: str) -> list[str]:
    """The columns of a DDL string, which are split at the commas outside of angle brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def kpi_catalog(from_csv: DataFrame | None, from_yaml: DataFrame | None) -> DataFrame | None:
    """The CSV catalog if it has rows, else the YAML catalog."""
    return from_csv if from_csv is not None and not from_csv.isEmpty() else from_yaml


def scan_reports(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """(file, the schema's columns, rank) of all report YAML files, rank 1 the newest by timestamp, then run id.

    The rank is over all reports of a folder, which one person's dashboards list.
    """
    rows = _yaml(spark, path).select("file", F.from_json("body", schema).alias("r")).select("file", "r.*")
    w = Window.orderBy(F.coalesce("timestamp", F.lit("")).desc(), F.coalesce("run_id", F.lit("")).desc())
    return rows.withColumn("rank", F.row_number().over(w))


def urls_from_export(spark: SparkSession, path: str, company: str, cap: int | None = None) -> DataFrame:
    """(pos, url) of the first export file in name order whose name begins with the company's; empty where none does.

    Files are called ``<company>..._sources_export.json`` and hold a JSON array.
    """
    first = min((p for p in _names(spark, path) if p.endswith(EXPORT_END) and p.startswith(company)), default=None)
    if first is None:
        return spark.createDataFrame([], "pos int, url string")
    one = spark.read.text(f"{path.rstrip('/')}/{first}", wholetext=True).select(F.from_json("value", "array<struct<url:string>>").alias("a"))
    rows = one.select(F.posexplode("a").alias("at", "x")).where("x.url <> ''").select(F.col("at").alias("pos"), "x.url")
    return rows.orderBy("pos").limit(cap) if cap else rows


EXPORT_END = "_sources_export.json"


def _names(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() == folders)


def company_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below ``root`` that hold an export file, in order."""
    return [d for d in _names(spark, root, True) if any(n.endswith(EXPORT_END) for n in _names(spark, f"{root.rstrip('/')}/{d}"))]


def scan_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def golden_source(source: str | None, from_db: DataFrame, from_yaml: DataFrame, merge) -> DataFrame:
    """Golden rows of the source named db, yaml or both (``merge`` of yaml and db); any other name is db."""
    name = (source or "db").strip().lower()
    if name == "both":
        return merge(from_yaml, from_db)
    return from_yaml if name == "yaml" else from_db


@dataclass(frozen=True)
class Flags:
    """What may be switched by the environment: names are the fields' in upper case behind a prefix."""

    n_scoring_runs: int = 5
    scoring_temperature: float = 0.7
    bertscore_enabled: bool = True
    cot_eval_enabled: bool = True


def feature_flags(env: dict[str, str], prefix: str = "VERITIDE_") -> Flags:
    """Flags from environment variables; values that are no numbers are ignored."""

    def number(name, kind, default):
        try:
            return kind(env[prefix + name]) if env.get(prefix + name) else default
        except ValueError:
            return default

    off = lambda name: env.get(prefix + name, "").lower() in ("1", "true")
    return Flags(
        number("N_SCORING_RUNS", int, 5), number("SCORING_TEMPERATURE", float, 0.7),
        not off("BERTSCORE_DISABLED"), not off("COT_EVAL_DISABLED"),
    )


def load_run(runs: DataFrame, scores: DataFrame, sources: DataFrame, companies: DataFrame, wanted: str, keys=("request_id", "run_uuid", "external_run_id", "pipeline_run_id")) -> tuple[DataFrame, DataFrame] | None:
    """(scores, sources) of one run of a result store whose link columns are only known at run time, with the company's name.

    ``wanted`` is a run's number or any of its keys.  Of the link columns that a table has, the one that
    matches most rows is taken; first with the company's rows alone, then with all.  None without such a run.
    """
    from veritide.operators.scopes import choose_column, resolve_run, typed_eq

    have = [c for c in ("id", *keys) if c in runs.columns]
    mine = None
    for c in have:
        mine = resolve_run(runs.where(typed_eq(runs, c, wanted)), *(k for k in keys if k in runs.columns)).first()
        if mine:
            break
    if not mine:
        return None
    links = [("run_id", str(mine["id"])), ("run_uuid", mine["run_key"]), ("request_id", mine["run_key"]), ("pipeline_run_id", mine["run_key"])]
    links = [(c, v) for c, v in links if v is not None]

    def scoped(table: DataFrame) -> DataFrame:
        own = table.where(F.col("company_id") == F.lit(mine["company_id"])) if "company_id" in table.columns else table
        for rows in (own, table):
            best = choose_column(rows, links)
            if best:
                return rows.where(typed_eq(rows, *best))
        return table.limit(0)

    name = companies.where(F.col("id") == F.lit(mine["company_id"])).select(F.col("name").alias("company"))
    with_name = lambda t: t.crossJoin(F.broadcast(name.limit(1)))  # one row
    return with_name(scoped(scores)), with_name(scoped(sources))
