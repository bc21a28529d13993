"""Slices, rollups, overviews and previews over the gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import parsing as P
from ..functions.calendar import period_key, trunc_ntz

ENERGY = ("consumo_total_kwh", "producao_total_kwh", "producao_dgm_kwh", "producao_pre_kwh", "saldo_kwh")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _sum0(name: str) -> Column:
    return _zero(F.sum(name))


def time_slice(
    df: DataFrame, start: datetime | None = None, end: datetime | None = None, ts: str = "timestamp_utc"
) -> DataFrame:
    """Rows with `start <= ts <= end`; a missing bound is open. The comparison reaches the Parquet scan."""
    for bound, keep in ((start, lambda b: F.col(ts) >= b), (end, lambda b: F.col(ts) <= b)):
        if bound is not None:
            df = df.where(keep(F.lit(bound.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")))
    return df


def with_completeness(gold: DataFrame) -> DataFrame:
    """Add `has_complete_data`: both totals known and no source missing."""
    complete = M.complete_reading(
        F.col("consumo_total_kwh"), F.col("producao_total_kwh"), F.col("flag_missing_source")
    )
    return gold.withColumn("has_complete_data", complete)


def balance_rollup(gold: DataFrame, grain: str = "day", series: Sequence[str] = ()) -> DataFrame:
    """Sums and hour counts per day or month. Deficit and surplus hours count only rows with both sources.

    Periods are grouped as instants and formatted once per result row.
    """
    present = ~M.is_true(F.col("flag_missing_source"))
    deficit = M.is_true(F.col("flag_defice"))
    surplus = M.is_true(F.col("flag_excedente"))
    rolled = (
        gold.where(F.col("timestamp_utc").isNotNull())
        .groupBy(*series, trunc_ntz(grain, F.col("timestamp_utc")).alias("_period"))
        .agg(
            *[_sum0(c).alias(c) for c in ENERGY],
            F.count_if(present & deficit).alias("defice_horas"),
            F.count_if(present & ~deficit & surplus).alias("excedente_horas"),
            F.count_if(~present).alias("missing_horas"),
            F.count(F.lit(1)).alias("leituras"),
            F.count_if(present).alias("leituras_completas"),
        )
    )
    ratio = F.when(F.col("consumo_total_kwh") > 0, F.col("producao_total_kwh") / F.col("consumo_total_kwh"))
    return rolled.select(
        *series,
        period_key(F.col("_period"), grain).alias("periodo"),
        *ENERGY,
        "defice_horas",
        "excedente_horas",
        "missing_horas",
        "leituras",
        "leituras_completas",
        ratio.alias("ratio_producao_consumo"),
    )


def balance_analytics(gold: DataFrame) -> DataFrame:
    """One row of totals, shares and hours per flag. Deficit hours here count every row."""
    totals = gold.where(F.col("timestamp_utc").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_horas"),
        _sum0("consumo_total_kwh").alias("total_consumo_kwh"),
        _sum0("producao_total_kwh").alias("total_producao_kwh"),
        _sum0("producao_pre_kwh").alias("total_producao_pre_kwh"),
        _sum0("producao_dgm_kwh").alias("total_producao_dgm_kwh"),
        _sum0("saldo_kwh").alias("saldo_total_kwh"),
        F.count_if(F.col("flag_defice")).alias("horas_defice"),
        F.count_if(F.col("flag_excedente")).alias("horas_excedente"),
        F.count_if(F.col("flag_missing_source")).alias("horas_missing_source"),
    )
    c = F.col
    return totals.withColumns(
        {
            "ratio_global_producao_consumo": M.guarded_ratio(c("total_producao_kwh"), c("total_consumo_kwh")),
            "share_pre_percentual": M.percentage(c("total_producao_pre_kwh"), c("total_producao_kwh")),
            "share_dgm_percentual": M.percentage(c("total_producao_dgm_kwh"), c("total_producao_kwh")),
            "percentual_defice": M.percentage(c("horas_defice").cast("double"), c("total_horas")),
        }
    )


def worst_deficits(gold: DataFrame, n: int = 10, ties: Sequence[str] = ("timestamp_utc",)) -> DataFrame:
    """The `n` hours with the lowest balance; unknown balances are left out."""
    known = gold.where(F.col("saldo_kwh").isNotNull())
    columns = list(dict.fromkeys([*ties, "timestamp_utc", "saldo_kwh", "consumo_total_kwh", "producao_total_kwh"]))
    return known.orderBy(F.col("saldo_kwh").asc(), *ties).limit(n).select(*columns)


def largest_imbalances(gold: DataFrame, n: int = 100, ties: Sequence[str] = ("timestamp_utc",)) -> DataFrame:
    """The `n` hours with the largest absolute balance, unknown balances last."""
    columns = list(
        dict.fromkeys(
            [
                *ties,
                "timestamp_utc",
                "consumo_total_kwh",
                "producao_total_kwh",
                "saldo_kwh",
                "ratio_producao_consumo",
                "flag_missing_source",
            ]
        )
    )
    return gold.orderBy(F.abs("saldo_kwh").desc_nulls_last(), *ties).limit(n).select(*columns)


def preview(df: DataFrame, n: int, order: Sequence[str], where: Column | None = None) -> DataFrame:
    """First `n` rows by `order` of those matching `where`."""
    return (df.where(where) if where is not None else df).orderBy(*order).limit(n)


def ends(df: DataFrame, n: int, order: str) -> DataFrame:
    """First and last `n` rows of a series, marked in `end`."""
    first = df.orderBy(F.col(order).asc()).limit(n).withColumn("end", F.lit("first"))
    last = df.orderBy(F.col(order).desc()).limit(n).withColumn("end", F.lit("last"))
    return first.unionByName(last)


def cost_rollup(cost: DataFrame, grain: str = "day") -> DataFrame:
    """Energy, cost, simple and weighted mean price per day or month."""
    rolled = cost.groupBy(trunc_ntz(grain, F.col("timestamp_utc")).alias("_period")).agg(
        F.sum("consumo_mwh").alias("consumo_mwh"),
        F.sum(F.col("consumo_mwh") * F.col("preco_eur_mwh")).alias("custo_estimado_eur"),
        F.avg("preco_eur_mwh").alias("preco_medio_simples_eur_mwh"),
        F.count(F.lit(1)).alias("leituras"),
    )
    weighted = _zero(M.guarded_ratio(F.col("custo_estimado_eur"), F.col("consumo_mwh")))
    return rolled.select(
        period_key(F.col("_period"), grain).alias("periodo"),
        "consumo_mwh",
        "custo_estimado_eur",
        "preco_medio_simples_eur_mwh",
        weighted.alias("preco_medio_ponderado_eur_mwh"),
        "leituras",
    )


def cost_overview(cost: DataFrame) -> DataFrame:
    """One row of totals, mean prices, interval and last point; zeros and nulls for an empty table."""
    spend = F.col("consumo_mwh") * F.col("preco_eur_mwh")
    totals = cost.agg(
        F.count(F.lit(1)).alias("registos"),
        F.min("timestamp_utc").alias("inicio"),
        F.max("timestamp_utc").alias("fim"),
        _sum0("consumo_mwh").alias("consumo_total_mwh"),
        _zero(F.sum(spend)).alias("custo_estimado_total_eur"),
        _zero(F.avg("preco_eur_mwh")).alias("preco_medio_simples_eur_mwh"),
        F.max_by("consumo_mwh", "timestamp_utc").alias("ultimo_consumo_mwh"),
        F.max_by("preco_eur_mwh", "timestamp_utc").alias("ultimo_preco_eur_mwh"),
    )
    return totals.withColumns(
        {
            "preco_medio_ponderado_eur_mwh": _zero(
                M.guarded_ratio(F.col("custo_estimado_total_eur"), F.col("consumo_total_mwh"))
            ),
            "ultimo_custo_estimado_eur": F.col("ultimo_consumo_mwh") * F.col("ultimo_preco_eur_mwh"),
        }
    )


def debug_profile(consumption: DataFrame, price: DataFrame, n: int = 5) -> DataFrame:
    """Records of both hourly series and of their intersection, with the first and last `n` of each."""
    both = consumption.select("timestamp_utc").join(price.select("timestamp_utc"), "timestamp_utc", "left_semi")
    parts = []
    for name, df, value in (
        ("consumo", consumption, "consumo_mwh"),
        ("preco", price, "preco_eur_mwh"),
        ("intersecao", both, None),
    ):
        rows = df.select("timestamp_utc", (F.col(value) if value else F.lit(None).cast("double")).alias("valor"))
        count = rows.agg(F.count(F.lit(1)).alias("registos"))  # one row
        parts.append(ends(rows, n, "timestamp_utc").crossJoin(F.broadcast(count)).withColumn("serie", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Names under which a grouped series may carry each column, in order of preference.
GROUPED_ALIASES = {
    "consumo_total": ("consumo_total", "consumo_total_kwh", "total_consumo", "total_consumo_kwh"),
    "producao_total": ("producao_total", "producao_total_kwh", "total_producao", "total_producao_kwh"),
    "producao_pre": ("producao_pre", "producao_pre_kwh", "total_producao_pre", "total_producao_pre_kwh"),
    "producao_dgm": ("producao_dgm", "producao_dgm_kwh", "total_producao_dgm", "total_producao_dgm_kwh"),
    "saldo": ("saldo", "saldo_kwh", "saldo_total", "saldo_total_kwh", "total_saldo_kwh"),
    "defice_horas": ("defice_horas", "horas_defice"),
    "excedente_horas": ("excedente_horas", "horas_excedente"),
    "leituras": ("leituras", "total_horas", "n_registos"),
}
PERIOD_ALIASES = ("periodo", "periodo_utc", "period", "chave_tempo")
RATIO_ALIASES = ("ratio_producao_consumo", "ratio_pc", "ratio")
UNKNOWN_PERIOD = "—"


def normalise_grouped(df: DataFrame) -> DataFrame:
    """A grouped series under its canonical names: known numbers, 0 where absent, ratio derived if missing."""
    numbers = {out: P.finite_or_zero(P.first_present(df, names)) for out, names in GROUPED_ALIASES.items()}
    named = df.select(
        P.first_present(df, PERIOD_ALIASES, UNKNOWN_PERIOD).cast("string").alias("periodo"),
        *[e.alias(out) for out, e in numbers.items()],
        P.first_present(df, RATIO_ALIASES).cast("double").alias("_ratio"),
    )
    derived = F.when(F.col("consumo_total") > 0, F.col("producao_total") / F.col("consumo_total"))
    return named.withColumn("ratio_producao_consumo", F.coalesce(F.col("_ratio"), derived)).drop("_ratio")


# Names under which an analytics row may carry each column, in order of preference.
ANALYTICS_ALIASES = {
    "consumo_total": ("total_consumo", "total_consumo_kwh", "consumo_total", "consumo_total_kwh"),
    "producao_total": ("total_producao", "total_producao_kwh", "producao_total", "producao_total_kwh"),
    "saldo_total": ("saldo_total", "saldo_total_kwh", "total_saldo", "total_saldo_kwh"),
    "producao_pre": ("total_producao_pre", "total_producao_pre_kwh", "producao_pre", "producao_pre_kwh"),
    "producao_dgm": ("total_producao_dgm", "total_producao_dgm_kwh", "producao_dgm", "producao_dgm_kwh"),
    "share_pre_percentual": ("share_pre_percentual", "percentual_pre", "peso_pre", "share_pre"),
    "share_dgm_percentual": ("share_dgm_percentual", "percentual_dgm", "peso_dgm", "share_dgm"),
}
HOUR_COUNT_ALIASES = ("total_horas", "registos", "leituras")
DEFICIT_SHARE_ALIASES = ("percentual_defice", "taxa_defice")
DEFICIT_HOUR_ALIASES = ("horas_defice", "defice_horas")
GLOBAL_RATIO_ALIASES = ("ratio_global_producao_consumo", *RATIO_ALIASES)
WORST_ALIASES = {
    "consumo_total": GROUPED_ALIASES["consumo_total"],
    "producao_total": GROUPED_ALIASES["producao_total"],
    "saldo": GROUPED_ALIASES["saldo"],
}
INSTANT_ALIASES = ("timestamp", "timestamp_utc", "momento_utc", "periodo")


def normalise_analytics(df: DataFrame) -> DataFrame:
    """An analytics row under its canonical names; the deficit share is derived from hours where it is missing."""
    numbers = {out: P.finite_or_zero(P.first_present(df, names)) for out, names in ANALYTICS_ALIASES.items()}
    # The share is over the hours counted under one of the first two names only.
    hours = P.finite_or_zero(P.first_present(df, HOUR_COUNT_ALIASES[:2]))
    derived = F.when(hours != 0, P.finite_or_zero(P.first_present(df, DEFICIT_HOUR_ALIASES)) / hours * 100).otherwise(F.lit(0.0))
    return df.select(
        P.first_present(df, HOUR_COUNT_ALIASES, 0).cast("long").alias("registos"),
        *[e.alias(out) for out, e in numbers.items()],
        P.first_present(df, GLOBAL_RATIO_ALIASES).cast("double").alias("ratio_producao_consumo"),
        F.coalesce(P.first_present(df, DEFICIT_SHARE_ALIASES).cast("double"), derived).alias("percentual_defice"),
    )


def normalise_worst_hours(df: DataFrame) -> DataFrame:
    """Worst hours under their canonical names, the ratio derived where it is missing."""
    numbers = {out: P.finite_or_zero(P.first_present(df, names)) for out, names in WORST_ALIASES.items()}
    named = df.select(
        P.first_present(df, INSTANT_ALIASES).alias("timestamp"),
        *[e.alias(out) for out, e in numbers.items()],
        P.first_present(df, RATIO_ALIASES).cast("double").alias("_ratio"),
    )
    derived = F.when(F.col("consumo_total") > 0, F.col("producao_total") / F.col("consumo_total"))
    return named.withColumn("ratio_producao_consumo", F.coalesce(F.col("_ratio"), derived)).drop("_ratio")
