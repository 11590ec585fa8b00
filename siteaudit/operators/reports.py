"""Reports over the wide view: ids, rows, counts, findings and export tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.expressions import display
from siteaudit.plans.catalogue import COLUMNS, SEVERITIES, Report, ReportColumn, compile_sql, condition, metric_column, reports


def column(column_id: str) -> ReportColumn | None:
    return COLUMNS.get(column_id)


def select(pv: DataFrame, report: Report, filter_id: str | None = None) -> DataFrame:
    """The wide rows of a report's filter. An unknown filter selects the whole report."""
    return pv.where(condition(report.base) & condition(report.filter(filter_id).predicate))


def _expression(c: ReportColumn) -> Column:
    return F.expr(compile_sql(c.expression))


def ordered(df: DataFrame, sort: str | None = None, ascending: bool = True, allowed: Iterable[str] | None = None) -> DataFrame:
    """In a column's order, NULLs last either way and ties by id. A column that the report does
    not have is ignored."""
    c = column(sort) if sort and (allowed is None or sort in allowed) else None
    if c is None:
        return df.orderBy(F.col("id").asc() if ascending else F.col("id").desc())
    e = _expression(c)
    return df.orderBy(e.asc_nulls_last() if ascending else e.desc_nulls_last(), "id")


def ids(pv: DataFrame, report: Report, filter_id: str | None = None, sort: str | None = None, ascending: bool = True) -> DataFrame:
    return ordered(select(pv, report, filter_id), sort, ascending, report.columns).select("id")


def table(pv: DataFrame, report: Report, filter_id: str | None = None, sort: str | None = None, ascending: bool = True, limit: int | None = None, shown: bool = True) -> DataFrame:
    """A report's rows with its own columns: as displayed text, or with their types."""
    df = ordered(select(pv, report, filter_id), sort, ascending, report.columns)
    return project(df if limit is None else df.limit(limit), report.columns, shown)


def project(df: DataFrame, columns: Sequence[str], shown: bool = True) -> DataFrame:
    exact = df.select("id", *[_expression(c).alias(c.id) for c in map(column, columns) if c])
    return exact.select("id", *[display(F.col(f.name), f.dataType).alias(f.name) for f in exact.schema.fields[1:]]) if shown else exact


def rows(pv: DataFrame, wanted: DataFrame, columns: Sequence[str], shown: bool = True) -> DataFrame:
    """Rows for (ordinal, id) in the order asked for; ids that are not known are left out."""
    picked = project(pv.join(wanted.select("id").distinct(), "id", "left_semi"), columns, shown)
    return wanted.join(picked, "id").orderBy("ordinal")


def counts(pv: DataFrame, of: Sequence[Report] | None = None) -> DataFrame:
    """(key, n) for every filter of every report, in one scan and one aggregation."""
    of = reports() if of is None else of
    keys = [(f"{r.id}.{f.id}", condition(r.base) & condition(f.predicate)) for r in of for f in r.filters]
    one = pv.agg(*[F.count_if(p).alias(f"c{i}") for i, (_, p) in enumerate(keys)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"c{i}").alias("n")) for i, (k, _) in enumerate(keys)])).alias("e")).select("e.key", "e.n")


def members(pv: DataFrame, report: Report) -> DataFrame:
    """(filter_id, id) for all filters of a report in one scan."""
    held = F.array_compact(F.array(*[F.when(condition(f.predicate), F.lit(f.id)) for f in report.filters]))
    return pv.where(condition(report.base)).select(F.explode(held).alias("filter_id"), "id")


def catalogue_frame(spark) -> DataFrame:
    """The filters as a table: key, report, filter, severity and its rank."""
    data = [(f"{r.id}.{f.id}", r.name, f.name, f.severity, SEVERITIES.index(f.severity) if f.severity else None) for r in reports() for f in r.filters]
    return spark.createDataFrame(data, "key string, report string, filter string, severity string, rank int")


def findings(counted: DataFrame) -> DataFrame:
    """Findings that occur, the worst band first, then by count, report and filter name."""
    found = counted.join(F.broadcast(catalogue_frame(counted.sparkSession)), "key").where("severity IS NOT NULL AND n > 0")
    return found.orderBy("rank", F.desc("n"), "report", "filter").select("severity", "report", "filter", "key", "n")


def band_totals(counted: DataFrame) -> DataFrame:
    """Sum of the findings of each severity band, those without any included."""
    known = counted.join(F.broadcast(catalogue_frame(counted.sparkSession)), "key").where("severity IS NOT NULL")
    return known.groupBy("severity", "rank").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("kinds")).orderBy("rank").select("severity", "total", "kinds")


def search_filters(text: str) -> list[tuple[str, str]]:
    """(report, filter) ids whose names contain the text."""
    t = text.strip().lower()
    return [(r.id, f.id) for r in reports() for f in r.filters if t in f.name.lower() or t in r.name.lower()] if t else []


def page(pv: DataFrame, report: Report, filter_id: str | None = None, sort: str | None = None, ascending: bool = True, after: tuple | None = None, size: int = 200) -> DataFrame:
    """The next ``size`` rows (value, id) of a report in its order, behind the row ``after`` = (value, id)
    that the page before ended with. What lies before is filtered out at the scan and never sorted."""
    df = select(pv, report, filter_id)
    c = column(sort) if sort and sort in report.columns else None
    value = _expression(c) if c else F.lit(None).cast("string")
    df = df.select(value.alias("value"), "id")
    v = F.col("value")
    if after is not None:
        last, last_id = after
        if c is None:
            df = df.where(F.col("id") > last_id if ascending else F.col("id") < last_id)
        elif last is None:  # NULLs stand last, by id
            df = df.where(v.isNull() & (F.col("id") > last_id))
        else:
            beyond = v > F.lit(last) if ascending else v < F.lit(last)
            df = df.where(v.isNull() | beyond | ((v == F.lit(last)) & (F.col("id") > last_id)))
    if c is None:
        return df.orderBy(F.col("id").asc() if ascending else F.col("id").desc()).limit(size)
    return df.orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last(), "id").limit(size)


def newer(pv: DataFrame, report: Report, last_id: int) -> DataFrame:
    """The report's rows found after ``last_id``, in order of discovery."""
    return select(pv, report).where(F.col("id") > last_id).orderBy("id").select("id")


__all__ = ["band_totals", "catalogue_frame", "column", "counts", "findings", "ids", "members", "metric_column", "newer", "ordered", "page", "project", "rows", "search_filters", "select", "table"]
