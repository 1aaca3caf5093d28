"""Fund flows beside the volume-price proxy, relative strength and shares of amount."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tidegauge.functions.expr import ratio


def cross_section() -> WindowSpec:
    return Window.partitionBy("kind", "as_of")


def fused(metrics: DataFrame, flows: DataFrame) -> DataFrame:
    """Joins direct flows by (kind, name, as_of); where they are missing the proxy stands in, with its source told.

    ``flows`` must have one row for each key; metrics without a name column use the code.
    """
    named = metrics if "name" in metrics.columns else metrics.withColumn("name", F.col("code"))
    return sourced(named.join(flows, ["kind", "name", "as_of"], "left"))


def sourced(rows: DataFrame) -> DataFrame:
    """Rows with direct flows and the proxy side by side: what counts, its source and its confidence."""
    new = {}
    for k in (1, 5, 10):
        direct, proxy = F.col(f"flow_{k}d_direct_pct"), F.col(f"flow_proxy_{k}d_pct")
        new[f"flow_{k}d_pct"] = F.coalesce(direct, proxy)
        new[f"flow_{k}d_source"] = F.when(direct.isNotNull(), "direct").when(proxy.isNotNull(), "cmf_proxy").otherwise("missing")
        new[f"flow_{k}d_confidence"] = F.when(direct.isNotNull(), 1.0).when(proxy.isNotNull(), 0.55).otherwise(0.0)
    d1, d5 = F.col("flow_1d_direct_pct"), F.col("flow_5d_direct_pct")
    p1, p5 = F.col("flow_proxy_1d_pct"), F.col("flow_proxy_5d_pct")
    same, proxies = d1.isNotNull() & d5.isNotNull(), d1.isNull() & d5.isNull() & (p1 - p5).isNotNull()
    new["flow_acceleration"] = F.when(same, d1 - d5 / 5).when(proxies, p1 - p5)
    new["flow_acceleration_source"] = F.when(same, "direct_same").when(proxies, "cmf_same").otherwise("not_comparable")
    return rows.withColumns(new)


def relative_strength(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({f"rs_{k}d": F.col(f"ret_{k}d") - F.median(f"ret_{k}d").over(cross_section()) for k in (5, 10)})


def amount_share(metrics: DataFrame) -> DataFrame:
    amount = F.greatest(F.coalesce("snapshot_amount", "last_amount") if "snapshot_amount" in metrics.columns else F.col("last_amount"), F.lit(0.0))
    return metrics.withColumn("amount_share", ratio(amount, F.sum(amount).over(cross_section())))
