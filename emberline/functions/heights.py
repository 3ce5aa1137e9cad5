"""Height bins, returned density and plant area density."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bin_index(z: Column, size: float = 2.0) -> Column:
    """Half-open bins of equal height."""
    return F.floor(z / F.lit(size)).cast("long")


def closed_bin_index(z: Column, bins: Column, size: float = 2.0) -> Column:
    """As bin_index, with the last of `bins` bins closed on the right."""
    return F.least(bin_index(z, size), bins - 1)


def bin_label(index: Column, size: float = 2.0) -> Column:
    low = index * F.lit(size)
    return F.format_string("%.1f-%.1fm", low, low + F.lit(size))


def label_low(label: Column) -> Column:
    """Lower edge of a bin label, negative ones included."""
    return F.regexp_extract(label, r"^(-?[0-9.]+)-", 1).cast("double")


def file_height(name: Column) -> Column:
    """Lower edge from a raster's file name, as `..._nrd_2m_to_4m` or `2-4`."""
    named = F.regexp_extract(name, r"_(?:nrd|pad)_(-?[0-9.]+)m", 1)
    plain = F.regexp_extract(name, r"(-?[0-9.]+)-[0-9.]+", 1)
    return F.when(named != "", named).when(plain != "", plain).cast("double")


def plant_area_density(nrd: Column, kappa: float = 0.6, size: float = 2.0) -> Column:
    """Beer and Lambert: -ln(1 - nrd) / (kappa size), kept in [0.1, 10]; 0 where nothing returned."""
    raw = -F.log(F.lit(1.0) - F.least(nrd, F.lit(0.9999))) / F.lit(kappa * size)
    return F.when(nrd <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(10.0), raw)))


def transmittance(nrd: Column) -> Column:
    return F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), nrd))


def stratum(low: Column) -> Column:
    return F.when(low >= 20, "canopy").when(low >= 10, "subcanopy").when(low >= 5, "understory").when(low >= 1, "shrub").otherwise("ground")
