"""Module, array and inverter equations as column expressions."""

from pyspark.sql import Column, functions as F

from ..config import InverterParameters, SystemConfig, ThermalConfig
from .values import _c, is_finite

# Fixed diagnostic scenarios: name, u0, u1.
THERMAL_SCENARIOS = (
    ("reference", 25.0, 6.84),
    ("u0_lower_20pct", 20.0, 6.84),
    ("u0_upper_20pct", 30.0, 6.84),
    ("u1_lower_25pct", 25.0, 5.13),
    ("u1_upper_25pct", 25.0, 8.55),
    ("combined_warmer", 20.0, 5.13),
    ("combined_cooler", 30.0, 8.55),
)


def cell_temperature(poa, ambient, wind, config: ThermalConfig = ThermalConfig(), u0=None, u1=None) -> Column:
    """Ambient plus irradiance over the wind-dependent heat loss."""
    a = F.lit(config.u0) if u0 is None else _c(u0)
    b = F.lit(config.u1) if u1 is None else _c(u1)
    return _c(ambient) + _c(poa) / (a + b * _c(wind))


def array_voltage(vmp, config: SystemConfig) -> Column:
    return _c(vmp) * config.modules_per_string


def array_current(imp, config: SystemConfig) -> Column:
    return _c(imp) * config.strings_per_inverter


def array_power(pmp, config: SystemConfig) -> Column:
    return _c(pmp) * (config.modules_per_string * config.strings_per_inverter)


def sandia_unclipped(v, p, q: InverterParameters) -> Column:
    """Quadratic conversion before the ceiling and the startup rule."""
    v, p = _c(v), _c(p)
    dv = v - q.vdco
    a = q.pdco * (1.0 + q.c1 * dv)
    b = q.pso * (1.0 + q.c2 * dv)
    c = q.c0 * (1.0 + q.c3 * dv)
    x = p - b
    return (q.paco / (a - b) - c * (a - b)) * x + c * x * x


def sandia_ac(v, p, q: InverterParameters, ceiling: float | None = None) -> Column:
    """AC power: capped at the rating (or an external ceiling), night tare below startup.

    NULL unless DC voltage and power are finite.
    """
    cap = q.paco if ceiling is None else ceiling
    out = F.when(_c(p) < q.pso, F.lit(-q.pnt)).otherwise(F.least(sandia_unclipped(v, p, q), F.lit(cap)))
    return F.when(is_finite(v) & is_finite(p), out)


def measured_power(v, i) -> Column:
    """V x I, only when both were measured."""
    return F.when(is_finite(v) & is_finite(i), _c(v) * _c(i))


def derated_power(power, k: float) -> Column:
    return _c(power) * k


def derated_current(power, voltage) -> Column:
    """Accounting current at unchanged voltage; zero at zero voltage."""
    return F.when(_c(voltage) > 0, _c(power) / _c(voltage)).otherwise(F.lit(0.0))
