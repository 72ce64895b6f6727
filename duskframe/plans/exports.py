"""Exports of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a page of HTML can have; larger results are written as files.
HTML_ROWS = 10_000


def export(df: DataFrame, path: str, form: str) -> None:
    """Write as json (records, ISO dates), csv (quoted text, header) or html (up to HTML_ROWS rows)."""
    if form == "json":
        df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSS]").json(path)
    elif form == "csv":
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes])
        flat.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    elif form == "html":
        page(df).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def page(df: DataFrame) -> DataFrame:
    """One row of HTML. More than HTML_ROWS rows are an error, since a page is made in one place."""
    if df.limit(HTML_ROWS + 1).count() > HTML_ROWS:
        raise ValueError(f"more than {HTML_ROWS} rows")
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    rows = df.select(F.concat(F.lit("<tr>"), *[cell(c) for c in df.columns], F.lit("</tr>")).alias("row"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    return rows.agg(F.concat(F.lit(f"<table>{head}"), F.array_join(F.collect_list("row"), ""), F.lit("</table>")).alias("value"))


def report(df: DataFrame, path: str) -> None:
    """CSV with a header, in one file; nothing for no rows."""
    if not df.isEmpty():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def with_collected_path(occurrences: DataFrame, folder: str) -> DataFrame:
    """Occurrences with the paths of their examples under `folder`."""
    moved = F.transform("examples", lambda e: e.withField("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.element_at(F.split(e["path"], "/"), -1))))
    return occurrences.withColumn("examples", moved)
