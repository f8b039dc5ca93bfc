"""Column -> Column functions; everything here stays inside Spark's own expressions."""

from flowlens.functions.actions import (
    VOCABULARIES,
    is_deny,
    is_permit,
    map_action,
    normalize_action,
    normalize_protocol,
)
from flowlens.functions.network import (
    is_external,
    port_category,
    port_category_rank,
    service_name,
    valid_ipv4,
    valid_port,
)
from flowlens.functions.numbers import count_where, non_null, percent, safe_divide, to_number
from flowlens.functions.text import blank_to_null, capitalize, key_value, pair_text, tcp_flags
from flowlens.functions.times import (
    as_ntz,
    floor_time,
    is_night,
    is_weekend,
    period_label,
    seconds_between,
    to_timestamp,
)

__all__ = [name for name in dir() if not name.startswith("_")]
