"""Composite salience, classes, stability and the three risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"pagerank": 0.30, "betweenness": 0.15, "authority": 0.15, "change_frequency": 0.15, "bus_factor_risk": 0.10, "code_size": 0.05, "test_presence": 0.10}


def bus_risk(bus_factor: Column) -> Column:
    """1 for one or none, else its inverse; 0 where it isn't known."""
    return F.when(bus_factor.isNull(), 0.0).when(bus_factor <= 1, 1.0).otherwise(1.0 / bus_factor)


def salience_class(pagerank: Column, frequency: Column, bus: Column) -> Column:
    """A central node of one owner (bus risk 0.99 and more) is a silo however often it changes."""
    high, hot = pagerank > 0.5, frequency > 0.5
    return F.when(high & (bus >= 0.99), "CriticalSilo").when(high & hot, "HotCritical").when(high, "FoundationalStable").when(hot, "ActiveLocalized").otherwise("Background")


def salience(features: DataFrame) -> DataFrame:
    """GR6, J12: features is (node, pagerank, betweenness, authority, change_percentile, bus_factor, code_size, test_presence), any
    of them null for 0. Size is over the greatest size. Score to 6 places."""
    f = features.crossJoin(F.broadcast(features.agg(F.greatest(F.lit(1.0), F.max("code_size").cast("double")).alias("__m"))))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    f = f.select("node", z("pagerank").alias("pagerank"), z("betweenness").alias("betweenness"), z("authority").alias("authority"), (z("change_percentile") / 100).alias("change_frequency"), bus_risk(F.col("bus_factor")).alias("bus_factor_risk"), (z("code_size") / F.col("__m")).alias("code_size"), z("test_presence").alias("test_presence"))
    score = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return f.select("node", F.round(score, 6).alias("score"), salience_class(F.col("pagerank"), F.col("change_frequency"), F.col("bus_factor_risk")).alias("classification"), *WEIGHTS)


def stability_class(pagerank: Column, churn: Column) -> Column:
    """GR11."""
    return F.when((pagerank > 0.5) & (churn <= 0.5), "StableCore").when(pagerank > 0.5, "ActiveCritical").when(churn <= 0.5, "ReliableBackground").otherwise("Volatile")


def declining(cls: Column, trend: Column) -> Column:
    """GR12: falling centrality makes Declining of what is neither ActiveCritical nor Volatile."""
    return F.when((trend == "Falling") & ~cls.isin("ActiveCritical", "Volatile"), "Declining").otherwise(cls)


def gate_score(salience_: Column, bus_factor: Column, changes: Column) -> Column:
    """N24, the gate's: 0.4 of the salience, 0.3 for one contributor or 0.15 for two, and 0.3, 0.2, 0.1 for over 20, 10, 5 changes;
    1 at most, to 6 places. What isn't known adds nothing."""
    bus = F.when(bus_factor <= 1, 0.3).when(bus_factor <= 2, 0.15).otherwise(0.0)
    often = F.when(changes > 20, 0.3).when(changes > 10, 0.2).when(changes > 5, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.coalesce(salience_.cast("double"), F.lit(0.0)) * 0.4 + bus + often), 6)


def risk_level(salience_: Column, bus_factor: Column, changes: Column) -> Column:
    """N24, the tool's: points for salience (3, 2, 1 over 0.7, 0.4, 0.2), one contributor (2) and changes (2, 1 over 20, 10): from
    2 on medium, 4 high, 6 critical."""
    n = F.when(salience_ > 0.7, 3).when(salience_ > 0.4, 2).when(salience_ > 0.2, 1).otherwise(0)
    n = n + F.when(bus_factor <= 1, 2).otherwise(0) + F.when(changes > 20, 2).when(changes > 10, 1).otherwise(0)
    return F.when(n >= 6, "critical").when(n >= 4, "high").when(n >= 2, "medium").otherwise("low")
