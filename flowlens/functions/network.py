"""Addresses and ports."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schemas import INTERNAL_PREFIX, PORT_RANGES, SERVICES


def valid_ipv4(ip: Column) -> Column:
    """Dotted quad whose four parts are 0..255; null is not valid."""
    shaped = ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    in_range = F.forall(F.split(ip, r"\."), lambda p: p.try_cast("int").between(0, 255))
    return F.coalesce(shaped & in_range, F.lit(False))


def valid_port(port: Column) -> Column:
    return F.coalesce(port.between(0, 65535), F.lit(False))


def is_external(ip: Column, prefix: str = INTERNAL_PREFIX) -> Column:
    """Outside the internal prefix; a missing address counts as external."""
    return ~F.coalesce(ip.startswith(prefix), F.lit(False))


def port_category(port: Column, zero_is_known: bool = True) -> Column:
    """RFC 6056 range label, 'Unknown' for null or out-of-range ports.

    ``zero_is_known=False`` leaves port 0 outside the first range.
    """
    number = port.try_cast("double") if zero_is_known else F.nullif(port.try_cast("double"), F.lit(0.0))
    branches = F
    for label, low, high in PORT_RANGES:
        branches = branches.when(number.between(low, high), label)
    return branches.otherwise("Unknown")


def port_category_rank(category: Column) -> Column:
    """Position of a range label, for sorting; unknown labels last."""
    branches = F
    for rank, (label, _, _) in enumerate(PORT_RANGES):
        branches = branches.when(category == label, rank)
    return branches.otherwise(len(PORT_RANGES))


def service_name(port: Column) -> Column:
    """Service name of a port, '' when it has none."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(SERVICES.items())])
    return F.coalesce(F.try_element_at(names, port.try_cast("int")), F.lit(""))
