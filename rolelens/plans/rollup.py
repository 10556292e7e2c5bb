"""A role's whole report from at most three reads of its table.

The first read counts the table once per combination of the report's keys (station, district, hour ...) and,
as further grouping sets of the same aggregate, once per value bucket of the measured columns. Everything in
this base table adds up, so grouped sections, one-row tables, ratios and the first level of the quantiles are
roll-ups of it. The second read holds what does not add up: distinct rentals, and the rows inside the
buckets that hold a quantile. Both results are stored. Single rows (a report's outliers) are a third read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolelens.functions import scalar as S
from rolelens.operators import segment as G
from rolelens.operators import summary as M
from rolelens.operators.ranks import locate
from rolelens.schema import require
from rolelens.session import work_path

MEASURED = ("usage_min", "distance_meter")
_IDS = ("station_id", "district")
_PARTS = {"n": F.count, "sum": F.sum, "min": F.min, "max": F.max}

def mean(column: str) -> Column:
    """The average of a measured column over rows of the base table."""
    return F.try_divide(F.sum(f"sum_{column}").cast("double"), F.sum(f"n_{column}"))


def total(name: str) -> Column:
    """The sum of a measure over the whole table; 0 for an empty one."""
    return F.coalesce(F.sum(name), F.lit(0))


def _rolled(measure: str) -> Column:
    return {
        "rentals": lambda: F.sum("n"),
        "avg_usage": lambda: mean("usage_min"),
        "avg_distance": lambda: mean("distance_meter"),
        "stations": lambda: F.count_distinct("station_id"),
        "first_rental": lambda: F.min("first_rental"),
        "last_rental": lambda: F.max("last_rental"),
    }[measure]()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: sections then read only their columns."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _collected(frames: Mapping[str, DataFrame]) -> dict[str, list[dict]]:
    """The located rows of each column, in one job: one row per quantile."""
    parts = [
        rows.select(
            F.lit(c).alias("of"), "_b", "slot", "within", (F.col("_lo") < F.col("_hi")).alias("open"),
            F.col("_lo").alias(f"lo_{c}"), F.col("_hi").alias(f"hi_{c}"),
        )
        for c, rows in frames.items()
    ]
    out: dict[str, list[dict]] = {c: [] for c in frames}
    if parts:
        for r in reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).collect():
            own = {n: r[n] for n in ("_b", "slot", "within", "open")}
            out[r["of"]].append({**own, "lo": r[f"lo_{r['of']}"], "hi": r[f"hi_{r['of']}"]})
    return out


class Rollup:
    """The stored base table of a scoped table. Making one runs the first read."""

    def __init__(
        self, scoped: DataFrame, segments: Sequence[str], measures: Mapping[str, Column], step: Mapping[str, int] = M.BUCKET_STEP
    ):
        """``segments`` are the grouped sections to come; ``measures`` further counts or sums, by name."""
        require(scoped, *_IDS, *MEASURED)
        for name in segments:
            require(scoped, *sorted(G.SPECS[name].columns()))
        self.scoped, self.measures = scoped, list(measures)
        self.keys = list(dict.fromkeys([*_IDS, *[k for n in segments for k in G.SPECS[n].keys]]))
        buckets = {c: M.first_bucket(scoped.schema[c].dataType, c, step.get(c, 1)) for c in MEASURED}
        narrow = scoped.select(
            *[G.KEYS[k][1]().alias(f"_{k}") for k in self.keys],
            *[b.alias(f"_bucket_{c}") for c, b in buckets.items()],
            *scoped.columns,
        )
        sets = [[f"_{k}" for k in self.keys], *[[f"_bucket_{c}"] for c in MEASURED]]
        flat = [k for s in sets for k in s]
        dates = [F.min("rental_date").alias("first_rental"), F.max("rental_date").alias("last_rental")]
        grouped = narrow.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in flat]).agg(
            F.grouping_id().alias("_gid"),
            F.count("*").alias("n"),
            *[f(c).alias(f"{p}_{c}") for c in MEASURED for p, f in _PARTS.items()],
            *(dates if "rental_date" in scoped.columns else []),
            *M.named(measures),
        )
        self.grouped = stored(grouped, "rollup")
        self.gids = [sum(1 << (len(flat) - 1 - i) for i, k in enumerate(flat) if k not in s) for s in sets]
        self.base = self.grouped.where(F.col("_gid") == self.gids[0]).withColumnsRenamed({f"_{k}": k for k in self.keys})

    def segment(self, name: str, extra: DataFrame | None = None) -> DataFrame:
        """``segment(scoped, name)``; measures that do not add up come from ``extra`` by the same keys."""
        spec = G.SPECS[name]
        added = [m for m in spec.measures if extra is not None and m in extra.columns]
        ranked = [F.desc("rentals")] if spec.by_count else []
        order = [*ranked, *[F.asc(k) for k in spec.keys]]
        out = self.base.groupBy(*spec.keys).agg(*[_rolled(m).alias(m) for m in spec.measures if m not in added])
        if spec.limit is not None:
            out = out.orderBy(*order).limit(spec.limit)
        if added:
            left, right = out.alias("l"), extra.alias("r")
            match = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in spec.keys])
            out = left.join(right, match, "left").select("l.*", *[F.coalesce(f"r.{m}", F.lit(0)).alias(m) for m in added])
        return out.select(*spec.keys, *spec.measures).orderBy(*order)

    def leaders(self, name: str) -> DataFrame:
        """Keys of the groups that a ranked section shows."""
        spec = G.SPECS[name]
        counts = self.base.groupBy(*spec.keys).agg(F.sum("n").alias("rentals"))
        return counts.orderBy(F.desc("rentals"), *[F.asc(k) for k in spec.keys]).limit(spec.limit).select(*spec.keys)

    def scalars(self, columns: Mapping[str, Column]) -> DataFrame:
        return self.base.agg(*M.named(columns))

    def kpis(self) -> DataFrame:
        sums = [F.sum(m).alias(m) for m in ("n", *M.kpi_measures())]
        return M.station_kpis(self.base.groupBy("station_id").agg(*sums))

    def histogram(self, column: str) -> DataFrame:
        return self.grouped.where(F.col("_gid") == self.gids[1 + MEASURED.index(column)]).select(
            F.col(f"_bucket_{column}").alias("_b"),
            F.col("n").alias("_n"),
            F.col(f"sum_{column}").alias("_sum"),
            F.col(f"min_{column}").alias("_lo"),
            F.col(f"max_{column}").alias("_hi"),
        )

    def detail(self, quantiles: Mapping[str, float], top: str | None = None) -> Detail:
        """The second read: distinct rentals, also per group of the ranked section ``top``, and quantiles."""
        return Detail(self, quantiles, top)


class Detail:
    """Distinct rentals and quantiles of a scoped table. Making one runs the second read."""

    def __init__(self, rollup: Rollup, quantiles: Mapping[str, float], top: str | None):
        scoped = rollup.scoped
        self.rollup, self.quantiles, self.names = rollup, quantiles, list(quantiles)
        self.keys = list(G.SPECS[top].keys) if top else []
        self.first = _collected({c: M.first_located(rollup.histogram(c), quantiles) for c in MEASURED})
        # a ranked section has as many groups as its limit
        leaders = rollup.leaders(top).collect() if top else []

        def item(kind: str, on: Column | None = None, **fields: Column) -> Column:
            types = {"id": "string", **{k: "string" for k in self.keys}, "slot": "int", "sub": "long"}
            types |= {f"v_{c}": scoped.schema[c].dataType for c in MEASURED}
            values = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
            made = F.struct(F.lit(kind).alias("kind"), *values)
            return made if on is None else F.when(on, made)

        items = [item("all", id=F.col("rental_id"))]
        if leaders:
            own = [reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(r[k])) for k in self.keys]) for r in leaders]
            listed = reduce(Column.__or__, own) & F.col("rental_id").isNotNull()
            items.append(item("group", listed, id=F.col("rental_id"), **{k: F.col(k) for k in self.keys}))
        for c in MEASURED:
            value, kind = F.col(c), scoped.schema[c].dataType
            for r in self.first[c]:
                if r["open"]:
                    lo, hi = F.lit(r["lo"]).cast(kind), F.lit(r["hi"]).cast(kind)
                    inside = value.between(lo, hi)
                    items.append(item("value", inside, slot=F.lit(r["slot"]), sub=M.sub_bucket(value, lo, hi), **{f"v_{c}": value}))
        rows = scoped.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*")
        parts = [F.count("*").alias("n")] + [f(f"v_{c}").alias(f"{p}_{c}") for c in MEASURED for p, f in (("lo", F.min), ("hi", F.max))]
        which = F.when(F.col("kind") == "value", F.when(F.col("v_distance_meter").isNotNull(), "distance_meter").otherwise("usage_min"))
        by = ["kind", *self.keys, "slot", "sub", "of"]
        once = rows.withColumn("of", which).groupBy(*by, "id").agg(*parts)
        merged = [F.count("*").alias("ids"), F.sum("n").alias("n")]
        merged += [f(f"{p}_{c}").alias(f"{p}_{c}") for c in MEASURED for p, f in (("lo", F.min), ("hi", F.max))]
        self.counted = stored(once.groupBy(*by).agg(*merged), "detail")
        self.last = _collected({c: self._refined(c) for c in MEASURED if any(r["open"] for r in self.first[c])})

    def distinct_counts(self) -> DataFrame:
        """Distinct rentals, stations and districts; NULL counts as one value."""
        parts = [self.counted.where("kind = 'all'").select(F.lit("rental_id").alias("column"), F.col("ids").alias("n"))]
        for c in _IDS:
            values = self.rollup.base.select(c).distinct()
            parts.append(values.agg(F.lit(c).alias("column"), F.count("*").alias("n")))
        stacked = reduce(DataFrame.unionByName, parts)
        names = ("rental_id", *_IDS)
        return stacked.agg(
            *[F.coalesce(F.max(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).alias(c) for c in names]
        )

    def unique_rentals(self) -> DataFrame:
        """Distinct rentals of the ranked section's groups; NULL is not counted."""
        return self.counted.where("kind = 'group'").select(*self.keys, F.col("ids").alias("unique_rentals"))

    def _refined(self, column: str) -> DataFrame:
        """The parts of buckets that hold the quantiles left open by the first level."""
        opened = [r for r in self.first[column] if r["open"]]
        slot = F.col("_slot")
        pairs = [
            F.when(slot == r["slot"], F.struct(F.lit(r["slot"]).alias("slot"), F.lit(r["within"]).alias("rank")))
            for r in opened
        ]
        hist = self.counted.where((F.col("kind") == "value") & (F.col("of") == column)).select(
            F.col("slot").alias("_slot"), "sub", "n", F.col(f"lo_{column}").alias("_lo"), F.col(f"hi_{column}").alias("_hi")
        )
        found = locate(
            hist.withColumn("_rank", F.array(F.coalesce(*pairs))), ["_slot"], "sub", "n", "_rank", keep=("_lo", "_hi")
        )
        buckets = F.coalesce(*[F.when(F.col("slot") == r["slot"], F.lit(r["_b"])) for r in opened])
        return found.withColumn("_b", buckets.cast("long"))

    def summary(self, column: str) -> DataFrame:
        """``numeric_summary`` of the column. Reads the table again only if a part of a bucket holds several values."""
        hist, scoped = self.rollup.histogram(column), self.rollup.scoped
        rows = [r for r in self.first[column] if not r["open"]] + self.last.get(column, [])
        kind = scoped.schema[column].dataType
        if not any(r["open"] for r in rows):
            return M.finished(hist, {self.names[r["slot"]]: F.lit(r["lo"]).cast(kind) for r in rows}, self.names)
        schema = M.first_located(hist, self.quantiles).schema
        at = {"_b": "_b", "_lo": "lo", "_hi": "hi", "slot": "slot", "within": "within"}
        located = scoped.sparkSession.createDataFrame([[r[at[n]] for n in schema.names] for r in rows], schema)
        return M.numeric_summary(scoped, column, self.quantiles, hist=hist, located=located)
