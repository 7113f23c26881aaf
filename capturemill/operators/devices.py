"""Graphics devices and memory tiers of processing hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that mark integrated and dedicated devices, and the memory tiers in GB.
INTEGRATED = (
    "INTEL", "IRIS", "HD GRAPHICS", "AMD RADEON(TM) GRAPHICS", "RADEON VEGA", "APU", "APPLE",
)
DEDICATED = ("NVIDIA", "AMD", "RADEON", "GEFORCE", "QUADRO", "TESLA")
READY_GB, WARN_GB = 8.0, 4.0


def _names_any(name, words):
    return reduce(lambda a, b: a | b, [F.contains(F.upper(name), F.lit(w)) for w in words])


def device_inventory(*probes: DataFrame) -> DataFrame:
    """Distinct device names per host over all probe tables, classed as dedicated or integrated."""
    names = reduce(DataFrame.unionByName, [p.select("host", "name") for p in probes]).distinct()
    dedicated = _names_any(F.col("name"), DEDICATED) & ~_names_any(F.col("name"), INTEGRATED)
    return names.withColumn("device_class", F.when(dedicated, "dedicated").otherwise("integrated"))


def host_tier(hosts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Memory tier and graphics label of each host; ``hosts`` is (host, ram_gb)."""
    best = inventory.groupBy("host").agg(F.max(F.col("device_class") == "dedicated").alias("dedicated"))
    ram = F.col("ram_gb")
    return hosts.select("host", "ram_gb").join(best, "host", "left").select(
        "host", "ram_gb",
        F.when(ram >= READY_GB, "READY").when(ram >= WARN_GB, "WARN").otherwise("INSUFFICIENT").alias("tier"),
        F.when(F.col("dedicated"), "dGPU").otherwise("iGPU").alias("graphics"),
    )
