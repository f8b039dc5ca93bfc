"""Column names, schemas and vocabularies of the data model."""

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """Schema from 'name type, name type'; works before a session exists."""
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


FLOW_KERNEL = _struct(
    "timestamp timestamp_ntz, hostname string, action string, fw bigint, rule bigint, "
    "interface_in string, interface_out string, src_ip string, dst_ip string, len bigint, "
    "ttl bigint, id bigint, df boolean, proto string, src_port bigint, dst_port bigint, "
    "window bigint, flags string"
)

FLOW_EXPORT = _struct(
    "timestamp timestamp_ntz, src_ip string, dst_ip string, proto string, src_port bigint, "
    "dst_port bigint, rule bigint, action string, interface_in string, interface_out string, "
    "fw bigint"
)

FLOW_LEGACY = _struct(
    "ipsrc string, ipdst string, portdst int, proto string, action string, "
    "date timestamp_ntz, regle string"
)

SYSLOG = _struct("timestamp timestamp_ntz, hostname string, process string, message string")

# Column names of the search-stack CSV export and their standard names.
KIBANA_RENAMES = {
    "@timestamp": "timestamp",
    "action": "action",
    "dstport": "dst_port",
    "interface": "interface_in",
    "interface_out": "interface_out",
    "ipdst": "dst_ip",
    "ipsrc": "src_ip",
    "policyid": "rule",
    "proto": "proto",
    "srcport": "src_port",
}
KIBANA_META = ("_id", "_ignored", "_index", "_score", "datetime")

# Log column -> canonical flow column.
CANONICAL_NAMES = {
    "src_ip": "ipsrc",
    "dst_ip": "ipdst",
    "src_port": "portsrc",
    "dst_port": "portdst",
    "timestamp": "date",
    "rule": "regle",
}

# Legacy feature column -> current feature column.
FEATURE_RENAMES = {
    "nombre": "total_flows",
    "cnbripdst": "unique_dst_ips",
    "cnportdst": "unique_dst_ports",
    "inf1024permit": "permit_low_port",
    "sup1024permit": "permit_high_port",
    "adminpermit": "permit_admin",
    "inf1024deny": "deny_low_port",
    "sup1024deny": "deny_high_port",
    "admindeny": "deny_admin",
    "risque": "risk",
}

# Feature names, in output order.
VOLUME_FEATURES = ["total_flows", "unique_dst_ips", "unique_dst_ports"]
FEATURES_11 = VOLUME_FEATURES + [
    "permit",
    "permit_low_port",
    "permit_high_port",
    "permit_admin",
    "deny",
    "deny_low_port",
    "deny_high_port",
    "deny_admin",
]
FEATURES_TIME = ["time_span_seconds", "access_rate", "unique_hours", "night_ratio", "weekend_ratio"]
FEATURES_RATIO = ["deny_ratio", "port_diversity", "admin_ratio", "system_port_ratio"]
FEATURES_STAT = ["avg_dst_port", "port_std", "port_min", "port_max", "port_range"]
PRESETS = {"course": FEATURES_11, "simple": VOLUME_FEATURES}

# Administration ports, low-port bound, internal address prefix.
ADMIN_PORTS = (21, 22, 3306, 3389)
ADMIN_PORTS_EXTENDED = (21, 22, 23, 139, 445, 1433, 3306, 3389, 5432)
LOW_PORT_MAX = 1024
INTERNAL_PREFIX = "159.84."

# Spellings read as null.
NULL_SPELLINGS = ("", "NA", "N/A", "-", "null", "NULL")
EMPTY_MARK = "(empty)"

# RFC 6056 port ranges.
PORT_RANGES = (
    ("Well-known (0-1023)", 0, 1023),
    ("Registered (1024-49151)", 1024, 49151),
    ("Dynamic/Private (49152-65535)", 49152, 65535),
)

# Service names of well-known ports.
SERVICES = {
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    80: "HTTP",
    110: "POP3",
    143: "IMAP",
    443: "HTTPS",
    445: "SMB",
    993: "IMAPS",
    995: "POP3S",
    3389: "RDP",
}

TARGET = "risk"
POSITIVE = "positive"
SEED = 42
