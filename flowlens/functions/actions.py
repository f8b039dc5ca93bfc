"""Firewall actions and protocols."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean permit / deny, per place where actions are read.
VOCABULARIES = {
    "features": (("PERMIT", "ALLOW", "ACCEPT"), ("DENY", "DROP", "REJECT", "BLOCK")),
    "logs": (("PERMIT", "ACCEPT"), ("DENY", "DROP", "REJECT")),
    "report": (("PERMIT", "ACCEPT", "ALLOWED"), ("DENY", "DROP", "REJECT")),
    "scalar": (
        ("PERMIT", "ALLOW", "ACCEPT", "PASS", "ALLOWED", "1", "TRUE"),
        ("DENY", "DROP", "BLOCK", "REJECT", "DENIED", "0", "FALSE"),
    ),
}

# IP protocol numbers and names.
PROTOCOLS = {"6": "TCP", "17": "UDP", "1": "ICMP", "58": "ICMPv6"}


def is_permit(action: Column, vocabulary: str = "features") -> Column:
    """True where the upper-cased action is one of the permit spellings; null stays false."""
    return F.coalesce(F.upper(action).isin(*VOCABULARIES[vocabulary][0]), F.lit(False))


def is_deny(action: Column, vocabulary: str = "features") -> Column:
    return F.coalesce(F.upper(action).isin(*VOCABULARIES[vocabulary][1]), F.lit(False))


def map_action(action: Column, vocabulary: str = "logs") -> Column:
    """Trimmed upper case; known spellings become PERMIT / DENY, others are kept."""
    permits, denies = VOCABULARIES[vocabulary]
    clean = F.upper(F.trim(action))
    return F.when(clean.isin(*permits), "PERMIT").when(clean.isin(*denies), "DENY").otherwise(clean)


def normalize_action(action: Column) -> Column:
    """'permit' / 'deny' under the widest vocabulary, otherwise the lower-cased input."""
    return F.lower(map_action(action, "scalar"))


def normalize_protocol(proto: Column) -> Column:
    """Protocol number or name in any case to its upper-case name."""
    clean = F.upper(F.trim(proto))
    branches = F
    for number, name in PROTOCOLS.items():
        branches = branches.when(clean == number, name)
    return branches.otherwise(clean)
