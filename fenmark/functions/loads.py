"""Nutrient formulas as column expressions; constants are parameters with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from fenmark.functions.numeric import round_half_even


@dataclass(frozen=True)
class Greenspace:
    threshold_ha: float = 1.0
    share: float = 0.2
    n_coeff: float = 3.0
    p_coeff: float = 0.2


@dataclass(frozen=True)
class Suds:
    threshold_dwellings: int = 50
    flow_share: float = 1.0
    reduction: float = 0.25


@dataclass(frozen=True)
class Settings:
    greenspace: Greenspace = Greenspace()
    suds: Suds = Suds()
    buffer_percent: float = 20.0
    fallback_works: int = 141
    days: float = 365.25
    mg_per_kg: float = 1_000_000.0
    load_factor: float = 0.9


def settings(conf: dict[str, str], base: Settings = Settings()) -> Settings:
    """base with what a session's settings say, as spark.fenmark.greenspace.share or spark.fenmark.bufferPercent; other names below
    spark.fenmark. are an error. Pass dict(spark.sparkContext.getConf().getAll())."""
    names = {"greenspace": {"thresholdHa": "threshold_ha", "share": "share", "nCoeff": "n_coeff", "pCoeff": "p_coeff"}, "suds": {"thresholdDwellings": "threshold_dwellings", "flowShare": "flow_share", "reduction": "reduction"}, "": {"bufferPercent": "buffer_percent", "fallbackWorks": "fallback_works", "days": "days", "mgPerKg": "mg_per_kg", "loadFactor": "load_factor"}}
    found: dict[str, dict] = {group: {} for group in names}
    for key, text in conf.items():
        if key.startswith("spark.fenmark."):
            group, _, name = key.removeprefix("spark.fenmark.").rpartition(".")
            if name not in names.get(group, {}):
                raise ValueError(f"unknown setting: {key}")
            field = names[group][name]
            old = getattr(getattr(base, group) if group else base, field)
            found[group][field] = type(old)(text)
    parts = {group: replace(getattr(base, group), **found[group]) for group in ("greenspace", "suds")}
    return replace(base, **found[""], **parts)


def land_use_uplift(area_ha: Column, site_ha: Column, current: Column, housing: Column, greenspace_coeff: float, g: Greenspace = Greenspace()) -> Column:
    """Load change of an area that becomes housing; sites from the threshold on keep a share of greenspace. Rounded to 2 places."""
    then = F.when(site_ha >= g.threshold_ha, housing * (1 - g.share) + F.lit(g.share * greenspace_coeff)).otherwise(housing)
    return round_half_even((then - current) * area_ha)


def suds_mitigation(uplift: Column, dwellings: Column, s: Suds = Suds()) -> Column:
    """What drainage takes off, a share of the absolute uplift for sites from the threshold on. Rounded to 2 places."""
    share = F.when(dwellings >= s.threshold_dwellings, s.flow_share * s.reduction).otherwise(0.0)
    return round_half_even(uplift - F.abs(uplift) * share)


def daily_water(dwellings: Column, occupancy: Column, litres: Column) -> Column:
    return dwellings * (occupancy * litres)


def wastewater_load(dwellings: Column, occupancy: Column, litres: Column, mg_per_litre: Column, s: Settings = Settings()) -> Column:
    """Kilograms a year."""
    return daily_water(dwellings, occupancy, litres) * s.days * ((mg_per_litre / s.mg_per_kg) * s.load_factor)


def with_buffer(land_use: Column, wastewater: Column, percent: float = 20.0) -> Column:
    """Both loads and a precaution: a share of the absolute sum."""
    total = land_use + wastewater
    return total + F.abs(total) * (percent / 100)


def band(total: Column) -> Column:
    """1 to 4 by 0.25, 2 and 5."""
    return F.when(total <= 0.25, 1).when(total <= 2, 2).when(total <= 5, 3).otherwise(4)


def highest_zone(zones: Column) -> Column:
    """The worst of an array of zone names; of unknown ones the first."""
    return F.when(F.array_contains(zones, "Red"), "Red").when(F.array_contains(zones, "Amber"), "Amber").when(F.array_contains(zones, "Green"), "Green").otherwise(F.get(zones, 0))
