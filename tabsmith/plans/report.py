"""Automatic report: choose charts from a profile, then compute them all."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.text import as_text, non_blank_tokens
from tabsmith.operators.charts import DEFAULT_BINS, bell_curve, bucket_of, is_numeric, period
from tabsmith.operators.cleaning import column
from tabsmith.operators.ranges import parse_range
from tabsmith.operators.tags import TagConfig, strip_prefix, tag_label
from tabsmith.plans.charts import PIE_MAX, ChartSpec, priority
from tabsmith.sources.shared import shared_folder

# A distribution this lopsided, or one that starts at zero, is shown without a bell curve.
SKEWED = 1.0
NEAR_ZERO = 0.05
# A category with more values than this share of its rows is an identifier and gets no chart.
IDENTIFIER_SHARE = 0.5
# The coarsest grain whose periods the dates fill: days up to two months, weeks up to a year, months up to ten.
GRAIN_DAYS = (("day", 62), ("week", 366), ("month", 3660))


def numeric_shape(df: DataFrame, dataset: str = "data") -> DataFrame:
    """Of every number and date, in one pass: dataset, name, skewness, min_value, max_value (of dates in days; no skewness)."""
    per_column = []
    for f in df.schema:
        if is_numeric(f.dataType):
            value, skewness = column(f.name).cast("double"), F.skewness(column(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value, skewness = F.unix_date(column(f.name).cast("date")).cast("double"), F.lit(None).cast("double")
        else:
            continue
        per_column.append(F.struct(
            F.lit(f.name).alias("name"), skewness.alias("skewness"),
            F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        ))
    if not per_column:
        return df.sparkSession.createDataFrame(
            [], "dataset string, name string, skewness double, min_value double, max_value double"
        )
    shapes = df.agg(F.array(*per_column).alias("rows")).select(F.inline("rows"))
    return shapes.select(F.lit(dataset).alias("dataset"), "*")


def recommend_charts(profile_df: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """One chart per chartable column: dataset, column, partition_type, chart_type, title, grain, position.

    Free text, columns without a value and categories so fine that they identify rows are left out. The grain of
    a date goes by its range. Without ``shapes`` (see `numeric_shape`) a number gets a histogram, a date months.
    """
    filled = F.col("row_count") - F.col("null_count")
    identifies = (F.col("category") == "categorical") & (F.col("distinct_count") > PIE_MAX) & (
        F.col("distinct_count") > filled * IDENTIFIER_SHARE)
    usable = profile_df.filter((F.col("category") != "free_text") & (filled > 0) & ~identifies)
    if shapes is None:
        joined = usable.withColumns({c: F.lit(None).cast("double") for c in ("skewness", "min_value", "max_value")})
    else:
        joined = usable.join(shapes, ["dataset", "name"], "left")
    starts_at_zero = (F.col("min_value") >= 0) & (F.col("min_value") <= F.col("max_value") * NEAR_ZERO)
    clusters = (F.abs("skewness") < SKEWED) & ~starts_at_zero
    category = F.col("category")
    return joined.select(
        "dataset",
        F.col("name").alias("column"),
        F.when(category == "datetime", "datetime")
        .when(category == "continuous_numerical", "numerical_bins")
        .otherwise("categorical").alias("partition_type"),
        F.when(category == "datetime", "line")
        .when(category == "continuous_numerical", F.when(clusters, "bell_curve").otherwise("histogram"))
        .when(F.col("distinct_count") <= PIE_MAX, "pie")
        .otherwise("bar").alias("chart_type"),
        F.concat(
            F.col("alias"), F.when(category == "datetime", " over time").otherwise(" distribution")
        ).alias("title"),
        F.when(category == "datetime", _grain(F.col("max_value") - F.col("min_value"))).alias("grain"),
        "position",
    )


def _grain(days: Column) -> Column:
    found = F.when(days.isNull(), "month")
    for name, most in GRAIN_DAYS:
        found = found.when(days <= most, name)
    return found.otherwise("year")


def chart_specs(recommendations: DataFrame, dataset: str = "data") -> list[ChartSpec]:
    """One dataset's recommendations as specs, in priority order (as many as it has columns)."""
    rows = (
        recommendations.filter(F.col("dataset") == dataset)
        .orderBy(priority(F.col("partition_type")), "position").collect()
    )
    return [
        ChartSpec(r["column"], r["partition_type"], r["chart_type"], r["title"], id=f"{r['partition_type']}:{r['column']}",
                  **({"grain": r["grain"]} if r["grain"] else {}))
        for r in rows
    ]


def regenerate(existing: Sequence[ChartSpec], fresh: Sequence[ChartSpec]) -> list[ChartSpec]:
    """Fresh automatic charts, followed by the charts a user added."""
    return [*fresh, *(s for s in existing if s.source == "custom")]


def auto_report(df: DataFrame, specs: Sequence[ChartSpec], folder: str | None = None) -> dict[str, DataFrame | Exception]:
    """Every chart as a DataFrame of its own; one that cannot be built or run carries its error instead.

    Counts, measures, tags and ranges share two scans of ``df``: one for the statistics of what is binned, one that
    turns each row into a cell per chart and sums the cells up. The result is stored in ``folder`` (a new one in the
    shared folder), from which the charts are read. A failure over the data is narrowed down by halves to the charts
    that cause it. Medians need their values in order and are worked out, and stored, chart by chart.
    """
    names = [s.id or str(i) for i, s in enumerate(specs)]
    out: dict[str, DataFrame | Exception] = dict.fromkeys(names)
    usable, medians = [], []
    for name, spec in zip(names, specs, strict=True):
        try:
            median = spec.measure and spec.agg == "median"
            (replace(spec, agg="count") if median else spec).apply(df)  # analysed only
            (medians if median else usable).append((name, spec))
        except Exception as exc:  # noqa: BLE001 - one bad chart must not sink the report
            out[name] = exc
    if usable or medians:
        folder = folder or shared_folder(df.sparkSession)
    todo, turns = [usable] if usable else [], 0
    while todo:
        part, turns = todo.pop(), turns + 1
        try:
            out |= _mixed(df, part, f"{folder}/{turns}")
        except Exception as exc:  # noqa: BLE001
            if len(part) == 1:
                out[part[0][0]] = exc
            else:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    for k, (name, spec) in enumerate(medians):
        try:
            found = spec.apply(df)
            found.write.parquet(f"{folder}/median{k}")
            order = [F.desc("value"), "category"] if spec.partition_type == "categorical" else [found.columns[0]]
            out[name] = df.sparkSession.read.schema(found.schema).parquet(f"{folder}/median{k}").orderBy(*order)
        except Exception as exc:  # noqa: BLE001
            out[name] = exc
    return out


def _binned_value(df: DataFrame, spec: ChartSpec) -> Column | None:
    """What a chart puts into bins of equal width; nothing for one that doesn't."""
    if spec.range and not spec.measure:
        return parse_range(as_text(column(spec.column), df.schema[spec.column].dataType), spec.range)
    if spec.partition_type != "numerical_bins" or spec.tags and not spec.measure:
        return None
    value = column(spec.column).cast("double")
    return F.when(column(spec.measure).isNotNull(), value) if spec.measure else value


def _mixed(df: DataFrame, charts: Sequence[tuple[str, ChartSpec]], folder: str) -> dict[str, DataFrame]:
    """The charts from two scans, as a tagged union: a cell has its chart's number and, of the columns for keys and for
    measures, one of each type, those that its chart uses."""
    values = {k: v for k, (_, s) in enumerate(charts) if (v := _binned_value(df, s)) is not None}
    statistics = [
        F.struct(F.avg(v).alias("mean"), F.stddev(v).alias("stddev"), F.min(v).alias("min_val"), F.max(v).alias("max_val")).alias(f"s{k}")
        for k, v in values.items()
    ]
    found = df.agg(*statistics).first() if statistics else None
    stats = {k: found[f"s{k}"] for k in values}

    keys: list[Column] = []
    for k, (_, spec) in enumerate(charts):
        if k in values:
            low, high = F.lit(stats[k]["min_val"]).cast("double"), F.lit(stats[k]["max_val"]).cast("double")
            keys.append(F.when(values[k].isNotNull(), bucket_of(values[k], low, high, spec.bins)))
        elif spec.tags and not spec.measure:
            text = strip_prefix(as_text(column(spec.column), df.schema[spec.column].dataType), spec.tags.prefix_separator)
            keys.append(_labels(text, spec.tags))
        elif spec.partition_type == "datetime":
            keys.append(period(spec.column, spec.grain))
        else:
            keys.append(column(spec.column))
    typed = df.select(*[key.alias(f"c{k}") for k, key in enumerate(keys)]).schema
    lists = {k for k, (_, s) in enumerate(charts) if s.tags and not s.measure}
    key_types = [f.dataType.elementType if k in lists else f.dataType for k, f in enumerate(typed.fields)]
    measured = {k: df.schema[s.measure].dataType for k, (_, s) in enumerate(charts) if s.measure}
    key_kinds, measure_kinds = (list(dict.fromkeys(t.simpleString() for t in ts)) for ts in (key_types, measured.values()))

    def cell(k: int, key: Column) -> Column:
        own, spec = key_types[k].simpleString(), charts[k][1]
        columns = [F.lit(k).alias("chart")]
        columns += [(key if t == own else F.lit(None).cast(t)).alias(f"k{i}") for i, t in enumerate(key_kinds)]
        has = measured[k].simpleString() if k in measured else None
        columns += [(column(spec.measure) if t == has else F.lit(None).cast(t)).alias(f"m{i}") for i, t in enumerate(measure_kinds)]
        return F.struct(*columns)

    singles = F.array(*[
        F.when(keys[k].isNotNull() & (column(s.measure).isNotNull() if s.measure else F.lit(True)), cell(k, keys[k]))
        for k, (_, s) in enumerate(charts) if k not in lists
    ]) if len(lists) < len(charts) else None
    spread = [F.transform(F.coalesce(keys[k], F.array().cast(typed[k].dataType)), _celled(cell, k)) for k in sorted(lists)]
    cells = F.concat(*([singles] if singles is not None else []), *spread)
    rows = df.select(F.inline(F.filter(cells, lambda c: c.isNotNull())))
    wanted = sorted({(measure_kinds.index(t.simpleString()), charts[k][1].agg) for k, t in measured.items()})
    states = [{"avg": F.avg, "sum": F.sum, "count": F.count}[agg](f"m{i}").alias(f"{agg}{i}") for i, agg in wanted]
    summed = rows.groupBy("chart", *[f"k{i}" for i in range(len(key_kinds))]).agg(F.count(F.lit(1)).alias("count"), *states)
    summed.write.partitionBy("chart").parquet(folder)
    stored = df.sparkSession.read.schema(summed.schema).parquet(folder)

    out = {}
    for k, (name, spec) in enumerate(charts):
        key = F.col(f"k{key_kinds.index(key_types[k].simpleString())}")
        value = "count" if k not in measured else f"{spec.agg}{measure_kinds.index(measured[k].simpleString())}"
        out[name] = _shaped(stored.filter(F.col("chart") == k), spec, key, F.col(value), stats.get(k))
    return out


def _labels(text: Column, config: TagConfig) -> Column:
    """The labels of a cell's tags; those that a vocabulary leaves out are dropped."""
    return F.filter(F.transform(non_blank_tokens(text, config.tag_separator or ","), lambda t: tag_label(t, config)), lambda t: t.isNotNull())


def _celled(cell: Callable[[int, Column], Column], k: int) -> Callable[[Column], Column]:
    return lambda key: cell(k, key)


def _shaped(rows: DataFrame, spec: ChartSpec, key: Column, value: Column, stats: Row | None) -> DataFrame:
    """One chart's rows as the chart by itself would give them."""
    if stats is not None:
        fixed = {c: F.lit(stats[c]).cast("double").alias(c) for c in ("mean", "stddev", "min_val", "max_val")}
        bucket = key.alias("bucket")
        if spec.measure:
            return rows.select(bucket, fixed["min_val"], fixed["max_val"], value.alias("value")).orderBy("bucket")
        if spec.range:
            return rows.select(bucket, value.alias("count"), fixed["min_val"], fixed["max_val"]).orderBy("bucket")
        found = rows.select(bucket, value.alias("count"), *fixed.values()).orderBy("bucket")
        return bell_curve(found, spec.bins) if spec.chart_type == "bell_curve" else found
    name = "value" if spec.measure else "count"
    if spec.partition_type == "datetime" and not (spec.tags and not spec.measure):
        return rows.select(key.alias("period"), value.alias(name)).orderBy("period")
    return rows.select(key.alias("category"), value.alias(name)).orderBy(F.desc(name), "category")


def report_counts(df: DataFrame, specs: Sequence[ChartSpec]) -> DataFrame:
    """All plain count charts of a report in long form: chart_id, key, count.

    One scan for the bounds of the binned columns, one for all the charts together and one shuffle of
    (chart, key) counts, instead of one or two scans per chart. No charts give no rows; a chart that is no
    plain count (a measure, tags, a range) is refused.
    """
    if other := [s.id or s.column for s in specs if s.measure or s.tags or s.range]:
        raise ValueError(f"not plain counts: {', '.join(other)}")
    if not specs:
        return df.sparkSession.createDataFrame([], "chart_id string, key string, count bigint")
    binned = [s for s in specs if s.partition_type == "numerical_bins"]
    rows = df
    if binned:
        bounds = df.agg(F.struct(*[
            F.struct(
                F.min(column(s.column).cast("double")).alias("lo"), F.max(column(s.column).cast("double")).alias("hi")
            ).alias(f"b{i}")
            for i, s in enumerate(binned)
        ])).scalar()
        rows = df.select("*", bounds.alias("_bounds"))

    def key(spec: ChartSpec):
        if spec.partition_type == "datetime":
            return F.date_format(period(spec.column, spec.grain), "yyyy-MM-dd")
        if spec.partition_type == "categorical":
            return column(spec.column).cast("string")
        at = f"_bounds.b{binned.index(spec)}"
        value = column(spec.column).cast("double")
        # The least() of a bucket ignores NULL, so an absent value must be kept out here.
        bucket = bucket_of(value, F.col(f"{at}.lo"), F.col(f"{at}.hi"), spec.bins or DEFAULT_BINS)
        return F.when(value.isNotNull(), bucket).cast("string")

    cells = [F.struct(F.lit(s.id or str(i)).alias("chart_id"), key(s).alias("key")) for i, s in enumerate(specs)]
    long = rows.select(F.inline(F.array(*cells))).filter("key IS NOT NULL")
    return long.groupBy("chart_id", "key").agg(F.count(F.lit(1)).alias("count"))
