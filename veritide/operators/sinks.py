"""Writers of reports, runs, snapshots, state, indexes and logs; all through Spark's committers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def report(kpis: DataFrame, pillars: DataFrame, keys: list[str]) -> DataFrame:
    """One nested row for each run: its KPI results and pillar scores, in the order of their names."""
    rest = lambda df: F.struct(*[c for c in df.columns if c not in keys])
    k = kpis.groupBy(*keys).agg(F.sort_array(F.collect_list(rest(kpis))).alias("kpi_results"))
    p = pillars.groupBy(*keys).agg(F.sort_array(F.collect_list(rest(pillars))).alias("pillar_scores"))
    return k.join(p, keys, "left")


def snapshot(kpis: DataFrame, keys: list[str], kpi: str, value: list[str]) -> DataFrame:
    """One row for each run with a map of its KPIs."""
    entry = F.struct(F.col(kpi), F.struct(*value))
    return kpis.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("kpis"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_yaml(df: DataFrame, path: str, name_col: str) -> None:
    """Write each row as a YAML file ``report_<name>.yaml``, its columns as keys in their order, nested ones too.

    Every task writes its own rows, each file under a name of its own first, so that a task that runs twice
    leaves one whole file.
    """
    import pyarrow as pa

    rows = df.select(F.col(name_col).cast("string").alias("_name"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_body"))

    def run(batches):
        import json

        import yaml
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for b in batches:
            names = b.column(0).to_pylist()
            for name, body in zip(names, b.column(1).to_pylist(), strict=True):
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(yaml.safe_dump(json.loads(body), sort_keys=False, allow_unicode=True).encode())
                store.move(part, f"{root}/report_{name}.yaml")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    rows.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def trace_events(rows: DataFrame, trace: str, time: Column, scores: list[str] = (), events: dict[str, Column] | None = None, spans: list[str] = ()) -> DataFrame:
    """(trace, kind, name, value, at): long rows of a trace store: each trace's scores, spans and the events that happened.

    scores: numeric columns; spans: columns whose text is logged; events: name -> condition.  Nulls log nothing.
    """
    one = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    parts = [one("score", c, F.col(c).cast("double")) for c in scores] + [one("span", c, F.col(c)) for c in spans]
    parts += [one("event", name, F.when(cond, "true")) for name, cond in (events or {}).items()]
    if not parts:
        raise ValueError("nothing to trace: name scores, spans or events")
    return rows.select(F.col(trace).alias("trace"), time.alias("at"), F.explode(F.array(*parts)).alias("x")).select("trace", "x.*", "at").where("value IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed state after an update: rows of ``new`` win over rows of ``old`` with the same keys."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("_age")
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_age")


def run_log(rows: DataFrame, run: str, params: list[str], metrics: list[str]) -> DataFrame:
    """(run, key, kind, value): long rows of a run store; keys are cut to 50 and values to 250 characters."""
    one = lambda c, kind: F.struct(F.lit(c[:50]).alias("key"), F.lit(kind).alias("kind"), F.substring(F.col(c).cast("string"), 1, 250).alias("value"))
    parts = [one(c, "param") for c in params] + [one(c, "metric") for c in metrics]
    return rows.select(F.col(run).alias("run"), F.explode(F.array(*parts)).alias("x")).select("run", "x.*").where("value IS NOT NULL")


def apply_ddl(spark: SparkSession, script: str) -> int:
    """Run the statements of a script, split at semicolons, without comment lines; returns their number."""
    lines = [ln for ln in script.splitlines() if not ln.strip().startswith("--")]
    done = 0
    for statement in "\n".join(lines).split(";"):
        if statement.strip():
            spark.sql(statement)
            done += 1
    return done
