"""Report tables as text, sweep tables, figure data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tall(row: DataFrame) -> DataFrame:
    """A one-row table as (position, metric, text): numbers with six significant digits, null as N/A."""
    cells = []
    for i, f in enumerate(row.schema):
        value = F.col(f"`{f.name}`")
        text = six_digits(value) if f.dataType.typeName() in ("double", "float") else value.cast("string")
        cells.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("metric"), F.coalesce(text, F.lit("N/A")).alias("text")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def six_digits(value):
    """C's %.6g: six significant digits, trailing zeros cut, an exponent below 1e-4 and from 1e6 on."""
    scaled = F.format_string("%.5e", value)
    mantissa, exponent = F.substring_index(scaled, "e", 1), F.substring_index(scaled, "e", -1).try_cast("int")
    strip = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    wide = F.format_string("%s%s", F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.lit(None).cast("string")
    for digits in range(10):
        plain = F.when(exponent == 5 - digits, F.format_string(f"%.{digits}f", value)).otherwise(plain)
    return F.when((exponent < -4) | (exponent >= 6), F.concat(strip(mantissa), wide)).otherwise(F.when(plain.contains("."), strip(plain)).otherwise(plain))


def table_text(row: DataFrame, title: str) -> DataFrame:
    """A metric table as one text value: title, rule, aligned `metric  :  value` lines."""
    cells = tall(row)
    width = max(len(c) for c in row.columns)
    line = F.concat(F.lit("  "), F.rpad("metric", width, " "), F.lit("  :  "), F.col("text"))
    lines = cells.agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    return lines.select(F.concat(F.lit(title + "\n" + "=" * 60 + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def sweep_pivot(rows: DataFrame, key: str, metric: str = "metric", value: str = "value") -> DataFrame:
    """metric x key: one row a metric, one column for each key value, in ascending order."""
    keys = sorted(r[0] for r in rows.select(key).distinct().collect())
    return rows.groupBy(metric).pivot(key, keys).agg(F.first(value))


class Publisher:
    """Writes the registered tables as text files, and figure data as Parquet, under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables, self.figures = spark, folder.rstrip("/"), {}, {}

    def add_table(self, name: str, title: str, row: DataFrame) -> Publisher:
        self.tables[name] = (title, row)
        return self

    def add_figure(self, name: str, data: DataFrame) -> Publisher:
        self.figures[name] = data
        return self

    def publish(self) -> list[str]:
        """The paths written: only what was registered."""
        out = []
        for name, (title, row) in self.tables.items():
            table_text(row, title).coalesce(1).write.mode("overwrite").text(path := f"{self.folder}/{name}")
            out.append(path)
        for name, data in self.figures.items():
            data.write.mode("overwrite").parquet(path := f"{self.folder}/{name}")
            out.append(path)
        return out


def console(rows: DataFrame, columns: list[str], width: int = 60, n: int = 20) -> str:
    """The first rows as aligned text, long values cut at `width` characters."""
    shown = rows.select(*[F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in columns]).limit(n).collect()
    sizes = [max([len(c), *(len(r[c] or "") for r in shown)]) for c in columns]
    lines = ["  ".join(c.ljust(s) for c, s in zip(columns, sizes, strict=True))]
    lines += ["  ".join((r[c] or "").ljust(s) for c, s in zip(columns, sizes, strict=True)) for r in shown]
    return "\n".join(lines)
