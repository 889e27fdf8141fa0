"""Distances, times and lens scalings of a Friedmann cosmology, by Simpson's rule inside one Column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clip

C_KM_S = 299792.458
STEPS = 512


class Cosmology:
    def __init__(self, h0: float = 70.0, matter: float = 0.3, dark: float = 0.7):
        self.h0, self.matter, self.dark = h0, matter, dark
        self.curvature = 1 - matter - dark

    def expansion(self, z: Column) -> Column:
        """H(z) / H0."""
        a = 1 + z
        return F.sqrt(self.matter * a * a * a + self.curvature * a * a + self.dark)

    def _simpson(self, z: Column, integrand) -> Column:
        step = z / STEPS
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * integrand(step * i))
        return F.when(z > 0, total * step / 3).when(z.isNotNull(), 0.0)

    def comoving(self, z: Column) -> Column:
        """Line-of-sight comoving distance in Mpc."""
        return C_KM_S / self.h0 * self._simpson(z, lambda x: 1 / self.expansion(x))

    def transverse(self, z: Column) -> Column:
        d = self.comoving(z)
        if abs(self.curvature) < 1e-8:
            return d
        root, hubble = math.sqrt(abs(self.curvature)), C_KM_S / self.h0
        bent = F.sinh if self.curvature > 0 else F.sin
        return hubble / root * bent(root * d / hubble)

    def angular_diameter(self, z: Column) -> Column:
        return self.transverse(z) / (1 + z)

    def luminosity(self, z: Column) -> Column:
        return self.transverse(z) * (1 + z)

    def between(self, z1: Column, z2: Column) -> Column:
        """Angular-diameter distance from z1 to z2 in a flat universe."""
        return F.when(z2 > z1, (self.transverse(z2) - self.transverse(z1)) / (1 + z2)).otherwise(0.0)

    def modulus(self, z: Column) -> Column:
        d = self.luminosity(z)
        return F.when(d > 0, 5 * F.log10(d * 1e5))

    def kpc_per_arcsec(self, z: Column) -> Column:
        return self.angular_diameter(z) * 1000 * math.pi / 648000

    def lookback(self, z: Column) -> Column:
        """Gyr."""
        return 977.79 / self.h0 * self._simpson(z, lambda x: 1 / ((1 + x) * self.expansion(x)))

    def volume(self, z: Column, square_degrees: float | None = None) -> Column:
        d = self.transverse(z)
        return 4 / 3 * math.pi * d * d * d * (1 if square_degrees is None else square_degrees / 41252.96)

    def redshift_of(self, spark, rows, mu: str, steps: int = 4096, z_max: float = 10.0):
        """Adds ``z_of_mu`` to rows: inverse modulus by linear interpolation on a fixed z grid, broadcast as one row."""
        z = F.exp(F.lit(math.log(1e-4)) + F.col("id") * (math.log(z_max / 1e-4) / steps))
        grid = spark.range(steps + 1).select(F.col("id"), z.alias("z")).withColumn("m", self.modulus(F.col("z")))
        grid = grid.agg(F.array_sort(F.collect_list(F.struct("m", "z"))).alias("grid"))
        rows = rows.join(F.broadcast(grid))
        k = F.aggregate(F.sequence(F.lit(0), F.lit(12)), F.struct(F.lit(0).alias("lo"), F.lit(steps).alias("hi")), lambda s, _: self._halve(s, F.col(mu)))
        rows = rows.withColumn("k_", k["lo"] + 1)
        a, b = F.element_at("grid", F.col("k_")), F.element_at("grid", F.least(F.col("k_") + 1, F.lit(steps + 1)))
        share = clip((F.col(mu) - a["m"]) / F.when(b["m"] > a["m"], b["m"] - a["m"]), 0, 1)
        return rows.withColumn("z_of_mu", a["z"] + F.coalesce(share, F.lit(0.0)) * (b["z"] - a["z"])).drop("grid", "k_")

    @staticmethod
    def _halve(s: Column, mu: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.element_at("grid", mid + 1)["m"] <= mu
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))


def physical_size(arcsec: Column, z: Column, cosmology: Cosmology) -> Column:
    """kpc."""
    return F.when((arcsec > 0) & (z > 0), arcsec * cosmology.kpc_per_arcsec(z))


def stellar_mass(luminosity: Column, colour: Column | None) -> Column:
    """Solar masses by the colour-dependent mass-to-light ratio of Bell et al. (2003); 2 without a colour."""
    ratio = F.lit(2.0) if colour is None else F.coalesce(F.pow(F.lit(10.0), -0.306 + 1.097 * clip(colour, -0.2, 1.6)), F.lit(2.0))
    return luminosity * ratio


def star_formation_rate(uv_luminosity: Column) -> Column:
    """Kennicutt (1998), solar masses a year."""
    return F.when(uv_luminosity > 0, 1.4e-28 * uv_luminosity * 3.828e33 / 1e28 * 1e-5)


def velocity_dispersion(theta_e: Column, z_lens: Column, z_source: Column, cosmology: Cosmology) -> Column:
    """km/s of an isothermal sphere with an Einstein radius in arcsec."""
    ratio = cosmology.angular_diameter(z_source) / F.nullif(cosmology.between(z_lens, z_source), F.lit(0.0))
    return F.when(theta_e > 0, C_KM_S * F.sqrt(F.radians(theta_e / 3600) / (4 * math.pi) * ratio))


def einstein_mass(theta_e: Column, z_lens: Column, z_source: Column, cosmology: Cosmology) -> Column:
    """Projected solar masses inside the Einstein radius: c^2 / 4G theta^2 Dl Ds / Dls."""
    g = 4.30091e-9  # Mpc (km/s)^2 per solar mass
    reach = cosmology.angular_diameter(z_lens) * cosmology.angular_diameter(z_source) / F.nullif(cosmology.between(z_lens, z_source), F.lit(0.0))
    theta = F.radians(theta_e / 3600)
    return F.when((theta_e > 0) & (z_lens > 0), C_KM_S**2 / (4 * g) * theta * theta * reach)
