"""Log readers on hand-written lines."""

import csv
import io
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowlens import sinks, sources
from flowlens.errors import ParsingError, ValidationError
from flowlens.operators.features import simple_features
from flowlens.schemas import FLOW_KERNEL
from flowlens.sources import delimited

HEAD = "{when} fw1 kernel: [12.5] {action} FW=6 RULE=999 IN=eth0 OUT= "
BODY = "SRC=94.102.61.47 DST=159.84.146.99 LEN=44 TTL=238 ID=5{more} PROTO=TCP SPT=52502 DPT=3178 WINDOW=65535 RES=0x00 {flags} URGP=0"


def line(when="Mar 20 01:29:24", action="DENY", flags="SYN", more=""):
    return HEAD.format(when=when, action=action) + BODY.format(flags=flags, more=more)


def write(path, lines, encoding="utf-8"):
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def test_kernel_line_fields(spark, tmp_path):
    path = write(tmp_path / "k.log", [line(), "noise", "", line(action="LOG"), "  " + line(action="ACCEPT") + "  "])
    df = sources.scan_kernel_log(spark, path, year=2025)
    assert df.schema.simpleString() == FLOW_KERNEL.simpleString()
    rows = df.collect()
    assert [r["action"] for r in rows] == ["DENY", "ACCEPT"]
    first = rows[0].asDict()
    assert first["timestamp"] == datetime(2025, 3, 20, 1, 29, 24)
    assert (first["fw"], first["rule"], first["len"], first["ttl"], first["id"]) == (6, 999, 44, 238, 5)
    assert (first["src_ip"], first["dst_ip"], first["interface_out"]) == ("94.102.61.47", "159.84.146.99", "")
    assert (first["src_port"], first["dst_port"], first["window"]) == (52502, 3178, 65535)
    assert (first["df"], first["flags"], first["proto"]) == (False, "SYN", "TCP")
    skipped = sources.skipped_lines(spark, path).first()
    assert (skipped["n_lines"], skipped["matched"], skipped["skipped"]) == (4, 2, 2)


def test_kernel_quirks(spark, tmp_path):
    lines = [
        line(when="Feb 29 01:00:00"),  # no such day in 2025
        line(when="Foo 10 01:00:00"),  # unknown month
        line(more=" DF ID=77"),  # last duplicate wins
        line(flags="ack PSH"),
        line(when="Mar 20 01:00:60"),
        line(when="Mar 20 01:00:00").replace("DPT=3178", "DPT=x1"),
    ]
    rows = sources.scan_kernel_log(spark, write(tmp_path / "q.log", lines), year=2025).collect()
    assert [r["timestamp"] is None for r in rows] == [True, True, False, False, True, False]
    assert rows[2]["id"] == 77 and rows[2]["df"]
    assert rows[3]["flags"] == "ACK,PSH"
    assert rows[5]["dst_port"] is None


def test_year_advances_per_file(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    write(folder / "a.log", [line(when=w) for w in ("Nov 1 00:00:00", "Dec 1 00:00:00", "Jan 2 00:00:00", "Jan 3 00:00:00")])
    write(folder / "b.log", [line(when=w) for w in ("Dec 30 00:00:00", "Jan 5 00:00:00", "Dec 31 00:00:00", "Jan 6 00:00:00")])

    def years(**options):
        df = sources.scan_kernel_log(spark, str(folder), year=2024, **options)
        return sorted(r["timestamp"].strftime("%Y-%m-%d") for r in df.collect())

    # A late December line after January advances the year again.
    assert years() == sorted(
        ["2024-11-01", "2024-12-01", "2025-01-02", "2025-01-03", "2024-12-30", "2025-01-05", "2025-12-31", "2026-01-06"]
    )
    # As parts of one log the second file goes on where the first ended.
    assert years(one_log=True) == sorted(
        ["2024-11-01", "2024-12-01", "2025-01-02", "2025-01-03", "2025-12-30", "2026-01-05", "2026-12-31", "2027-01-06"]
    )
    assert {y[:4] for y in years(infer_year=False)} == {"2024"}


def test_year_does_not_depend_on_splits(spark, tmp_path):
    months = ["Jan", "Mar", "Jun", "Sep", "Dec"]
    lines = [line(when=f"{m} {d} 00:00:00", more=f" ID={y * 1000 + i * 10 + d}") for y in range(8) for i, m in enumerate(months) for d in range(1, 6)]
    path = write(tmp_path / "years.log", lines)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for size in ("128m", "2000b"):
            spark.conf.set(name, size)
            df = sources.scan_kernel_log(spark, path, year=2000)
            assert size == "128m" or df.rdd.getNumPartitions() > 10
            rows = df.select("id", F.year("timestamp").alias("y")).collect()
            assert len(rows) == len(lines)
            assert all(r["y"] == 2000 + r["id"] // 1000 for r in rows)
    finally:
        spark.conf.set(name, before)


def test_large_change_tables_are_joined_not_broadcast(spark, tmp_path, monkeypatch):
    from flowlens.sources import kernel

    monkeypatch.setattr(kernel, "BROADCAST_ENTRIES", 0)
    path = write(tmp_path / "j.log", [line(when="Dec 1 00:00:00"), line(when="Jan 1 00:00:00")])
    rows = sources.scan_kernel_log(spark, path, year=2024).collect()
    assert sorted(r["timestamp"].year for r in rows) == [2024, 2025]


def test_lines_parse_in_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.log", [line(), "noise"])
    stream = sources.parse_kernel_lines(spark.readStream.text(str(folder)), 2025)
    query = stream.writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("parsed").count() == 1


def test_syslog(spark, tmp_path):
    lines = ["Jan 15 08:23:11 host sshd[812]: Failed: password", "garbage", "Mars 1 1:2:3 h p: m"]
    rows = sources.scan_syslog(spark, write(tmp_path / "s.log", lines), year=2023, with_pid=True).collect()
    assert rows[0].asDict() == {
        "timestamp": datetime(2023, 1, 15, 8, 23, 11), "hostname": "host", "process": "sshd[812]",
        "message": "Failed: password", "pid": 812,
    }
    assert rows[1]["message"] == "garbage" and rows[1]["hostname"] is None
    assert rows[2]["timestamp"] is None and rows[2]["process"] == "p"


def test_export_with_bom_and_bad_lines(spark, tmp_path):
    lines = [
        "\ufeff11-2-2025 1:29:24;94.102.61.47;159.84.146.99;TCP;52502;3178;999; deny ;eth0;;6",
        "2025-03-20 01:29:24;1.1.1.1;2.2.2.2; UDP ;x;53;1;PERMIT;eth1;eth2;6",
        "2025-03-20 01:29:24;1.1.1.1;2.2.2.2;UDP;1;53;1;PERMIT;eth1;eth2;6;extra",
        "2025-03-20 01:29:24;1.1.1.1;2.2.2.2",
    ]
    rows = sources.scan_firewall_export(spark, write(tmp_path / "e.csv", lines)).collect()
    assert len(rows) == 3
    assert rows[0]["timestamp"] == datetime(2025, 11, 2, 1, 29, 24)
    assert (rows[0]["action"], rows[0]["interface_out"], rows[0]["fw"]) == ("DENY", None, 6)
    assert (rows[1]["src_port"], rows[1]["proto"]) == (None, "UDP")
    assert rows[2]["action"] is None


def test_kibana_export(spark, tmp_path):
    lines = [
        "@timestamp,_id,_ignored,_index,_score,action,action.keyword,datetime,dstport,interface,interface_out,ipdst,ipsrc,policyid,proto,srcport,note",
        '"Mar 2, 2026 @ 20:45:01.000",a,-,i,1,permit ,permit,x,443,eth0,(empty),1.1.1.1,2.2.2.2,7,TCP,5000,"a, b"',
        "broken,a,-,i,1,deny,deny,x,(empty),eth0,(empty),1.1.1.1,(empty),7,TCP,5000,c",
    ]
    df = sources.scan_kibana_export(spark, write(tmp_path / "k.csv", lines))
    assert df.columns == [*FLOW_KERNEL.fieldNames(), "note"]
    rows = df.collect()
    assert rows[0]["timestamp"] == datetime(2026, 3, 2, 20, 45, 1)
    assert (rows[0]["action"], rows[0]["dst_port"], rows[0]["interface_out"], rows[0]["df"]) == ("PERMIT", 443, None, False)
    assert rows[0]["note"] == "a, b"
    assert (rows[1]["timestamp"], rows[1]["src_ip"], rows[1]["dst_port"]) == (None, None, None)


def test_legacy_header_and_capitals(spark, tmp_path):
    lines = ["ipsrc,ipdst,portdst,proto,action,date,regle", "1.1.1.1,2.2.2.2,80.0,TCP, DENY all,2024-01-02 03:04:05,9"]
    path = write(tmp_path / "l.csv", lines)
    row = sources.scan_firewall_csv(spark, path).collect()
    assert len(row) == 1
    assert (row[0]["action"], row[0]["portdst"], row[0]["date"]) == ("Deny all", 80, datetime(2024, 1, 2, 3, 4, 5))
    assert sources.scan_firewall_csv(spark, path, header=False).count() == 2


def test_generic_csv(spark, tmp_path):
    lines = ["# a", "# b", "x|1|02/03/2024|N/A", "y|z|bad|ok"]
    path = write(tmp_path / "g.csv", lines)
    df = sources.scan_csv(
        spark, path, columns=["k", "n", "d", "t"], separator="|", skiprows=2, dtype={"n": "int"},
        date_columns=["d"], date_format="dd/MM/yyyy", transformations={"k": lambda c: F.upper(c)},
    )
    assert [tuple(r) for r in df.collect()] == [("X", 1, datetime(2024, 3, 2), None), ("Y", None, None, "ok")]


def test_latin1(spark, tmp_path):
    path = write(tmp_path / "l1.csv", ["name,v", "café,1"], "latin-1")
    assert sources.scan_csv(spark, path, encoding="ISO-8859-1").first()["name"] == "café"
    log = write(tmp_path / "l1.log", ["Jan 1 00:00:00 h p: café"], "latin-1")
    assert sources.scan_syslog(spark, log, year=2024).first()["message"] == "caf�"


def test_registry_and_strict_loading(spark, tmp_path):
    good = write(tmp_path / "good.csv", ["2025-03-20 01:29:24;1.1.1.1;2.2.2.2;UDP;1;53;1;PERMIT;a;b;6"])
    bad = write(tmp_path / "bad.csv", ["nodate;1.1.1.1;2.2.2.2;UDP;1;53;1;LOG;a;b;6"])
    assert sources.load_logs(spark, "firewall_export", good).count() == 1
    with pytest.raises(ValidationError) as failure:
        sources.load_logs(spark, "firewall_export", bad)
    assert len(failure.value.errors) == 2
    with pytest.raises(ParsingError):
        sources.load_logs(spark, "kernel_firewall", good)
    with pytest.raises(ParsingError):
        sources.scan(spark, "unknown", good)
    sources.register_parser("lines", lambda spark, path: spark.read.text(path))
    assert "lines" in sources.list_parsers() and sources.scan(spark, "lines", good).count() == 1


def test_feature_store(spark, sf_dir, tmp_path):
    from flowlens.fixtures import flows

    folder = str(tmp_path / "store")
    features = simple_features(flows(spark, sf_dir))
    sinks.save_feature_set(features, folder, "a", {"note": "x"})
    sinks.save_feature_set(features, folder, "b")
    assert sinks.list_feature_sets(spark, folder) == ["a", "b"]
    stored = sinks.load_feature_set(spark, folder, "a")
    assert stored.feature_names == features.feature_names and stored.metadata["note"] == "x"
    assert stored.data.count() == features.data.count() == stored.metadata["num_samples"]
    sinks.delete_feature_set(spark, folder, "a")
    assert sinks.list_feature_sets(spark, folder) == ["b"]


def test_stored_features_with_the_same_value_in_all_rows_come_back(spark, tmp_path):
    rows = [("a", "x", 80, "PERMIT"), ("a", "y", 80, "DENY"), ("b", "x", 443, "DENY")]
    features = simple_features(spark.createDataFrame(rows, "ipsrc string, ipdst string, portdst int, action string"))
    assert features.feature_names == ["total_flows", "unique_dst_ips"]
    sinks.save_feature_set(features, str(tmp_path / "store"), "a")
    stored = sinks.load_feature_set(spark, str(tmp_path / "store"), "a")
    assert stored.data.columns == ["ipsrc", "total_flows", "unique_dst_ips"]
    whole = stored.with_constants().select("ipsrc", "total_flows", "unique_dst_ports")
    assert whole.dtypes[2] == ("unique_dst_ports", "bigint")
    assert sorted(map(tuple, whole.collect())) == [("a", 2, 1), ("b", 1, 1)]


def test_day_partitions_prune(spark, sf_dir, tmp_path):
    from flowlens.fixtures import flows

    path = sinks.write_flows(flows(spark, sf_dir), str(tmp_path / "days"))
    plan = spark.read.parquet(path).filter("day = date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_headers_of_several_files_and_quotes(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text('ipsrc,portdst,note\n10.0.0.1,80,"a;""b"\n10.0.0.2,81,"open\n')
    (folder / "b.csv").write_text("portdst,ipsrc\n443,10.0.0.3\n")
    rows = sources.scan_csv(spark, str(folder)).collect()
    got = sorted((r.ipsrc, r.portdst, r.note) for r in rows)
    assert got == [("10.0.0.1", "80", 'a;"b'), ("10.0.0.3", "443", None)]
    counts = delimited.dropped_lines(spark, str(folder / "a.csv"), ["ipsrc", "portdst", "note"]).first()
    assert (counts.n_lines, counts.too_long, counts.unbalanced) == (3, 0, 1)


def test_latin1_files_beside_utf8(spark, tmp_path):
    folder = tmp_path / "encodings"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("name,n\ncaf\u00e9,1\n".encode("latin-1"))
    (folder / "u.csv").write_bytes("name,n\nth\u00e9,2\n".encode())
    rows = sources.scan_csv(spark, str(folder), encoding="auto").collect()
    assert sorted(r.name for r in rows) == ["caf\u00e9", "th\u00e9"]


def test_forged_marks_are_no_header(spark, tmp_path):
    (tmp_path / "kern.log").write_text("\u0001Jan\u00011\u000100:00:00\u0001h\u0001DENY\u0001SRC=1.2.3.4\n")
    assert sources.scan_kernel_log(spark, str(tmp_path / "kern.log"), year=2024).count() == 0


def test_periods_read_only_their_days(spark, tmp_path):
    from flowlens import sinks

    rows = spark.sql("select timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(cast(id as int)) as timestamp, id from range(20)")
    path = sinks.write_flows(rows, str(tmp_path / "flows"), "timestamp")
    df = sources.load_flows_parquet(spark, path, date_filter=("2024-01-03", "2024-01-05"))
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_rotated_logs_in_a_given_order(spark, tmp_path):
    folder = tmp_path / "rotated"
    folder.mkdir()
    for name, month in (("kern.log.10", "Nov"), ("kern.log.2", "Dec"), ("kern.log", "Jan")):
        (folder / name).write_text(line(when=f"{month} 20 01:29:24") + "\n")
    times = [r.timestamp.year for r in sources.scan_kernel_log(
        spark, str(folder), year=2023, one_log=["kern.log.10", "kern.log.2", "kern.log"]
    ).orderBy("timestamp").collect()]
    assert times == [2023, 2023, 2024]
    by_name = sources.scan_kernel_log(spark, str(folder), year=2023, one_log=True).select("timestamp").collect()
    assert sorted(r.timestamp.strftime("%y%m") for r in by_name) == ["2301", "2312", "2411"]


def test_logs_split_otherwise_are_refused(spark):
    from flowlens.sources.kernel import infer_log_year

    heads = spark.createDataFrame([("f", 0, 1, 12), ("f", 0, 2, 1)], "_file string, _block long, _id long, month int")
    assert [r._year for r in infer_log_year(heads, 2023).orderBy("_id").collect()] == [2023, 2024]


def in_splits(spark, size, run):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, size)
        return run()
    finally:
        spark.conf.set(name, before)


def quoted_text(rng, rows):
    """A file whose notes hold breaks, quotes and separators, and the rows that a plain reader finds in it."""
    parts = ["\n", "\n\n", '"', ",", "text", " ", "é", ""]
    out = [["id", "note", "last"]]
    for i in range(rows):
        note = "".join(rng.choices(parts, k=rng.randint(0, 6))) if rng.random() < 0.5 else "plain"
        out.append([str(i), note, rng.choice(["x", 'a "b" c', "5\" disk", ""])])
    lines = []
    for a, note, last in out:
        quoted = any(c in note for c in '\n",') or rng.random() < 0.2
        lines.append(f'{a},"{note.replace(chr(34), chr(34) * 2)}",{last}' if quoted else f"{a},{note},{last}")
    return "\n".join(lines) + "\n", out[1:]


@pytest.mark.parametrize("seed", range(3))
def test_quoted_breaks_at_split_borders(spark, tmp_path, seed):
    folder = tmp_path / "quoted"
    folder.mkdir()
    want = []
    for k in range(3):
        text, rows = quoted_text(random.Random(10 * seed + k), 60)
        (folder / f"f{k}.csv").write_text(text)
        read = list(csv.reader(io.StringIO(text, newline="")))[1:]
        assert [r[:2] for r in read] == [r[:2] for r in rows]  # the plain reader agrees on what was written
        want += [tuple(x or None for x in r) for r in rows]
    (folder / "plain.csv").write_text("id,note,last\n1000,no breaks,here\n")
    want.append(("1000", "no breaks", "here"))
    read = lambda: [tuple(r) for r in sources.scan_csv(spark, str(folder), na_values=("",)).select("id", "note", "last").collect()]
    stripped = lambda rows: sorted(tuple((x or "").strip() for x in r) for r in rows)
    for size in ("128m", "200b", "37b"):
        got = in_splits(spark, size, read)
        assert sorted(r[0] for r in got) == sorted(r[0] for r in want)
        assert stripped(got) == stripped(want)


def test_one_record_over_many_splits_and_a_quote_that_stays_open(spark, tmp_path):
    body = "\n".join(f"line {i}" for i in range(200))
    text = f'a,b\n1,"{body}"\n2,x\n3,"open\n4,y\n5,"""z"""\n6,5" disk\n'
    (tmp_path / "r.csv").write_text(text[: text.index("5,")] + "6,w\n")
    path = str(tmp_path / "r.csv")
    for size in ("128m", "100b"):
        rows = in_splits(spark, size, lambda: {r.a: r.b for r in sources.scan_csv(spark, path).collect()})
        assert rows == {"1": body, "2": "x", "4": "y", "6": "w"}
        counts = in_splits(spark, size, lambda: delimited.dropped_lines(spark, path, ["a", "b"]).first())
        assert (counts.n_lines, counts.too_long, counts.unbalanced) == (6, 0, 1)


def test_quotes_inside_unquoted_fields_are_text(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,5" disk\n2,"x, y"\n3,c"d"e\n')
    rows = {r.a: r.b for r in sources.scan_csv(spark, str(tmp_path / "q.csv")).collect()}
    assert rows == {"1": '5" disk', "2": "x, y", "3": 'c"d"e'}


def test_line_functions_against_a_plain_automaton(spark):
    from flowlens.sources.records import field_count, opens, stays

    def run(line, inside, sep):
        state, fields = ("in" if inside else "start"), 1
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c == sep else "plain"
                fields += c == sep
            elif state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote" and c == '"':
                state = "in"
            else:
                fields += c == sep
                state = "start" if c == sep else "plain"
        return state == "in", fields

    rng = random.Random(4)
    lines = list({"".join(rng.choices('",;ab', k=rng.randint(0, 9))) for _ in range(3000)})
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for sep in (",", ";"):
        v = F.col("value")
        got = df.select(v, opens(v, sep).alias("o"), stays(v, sep).alias("s"), field_count(v, sep).alias("n")).collect()
        for r in got:
            assert (r.o, r.s) == (run(r.value, False, sep)[0], run(r.value, True, sep)[0]), r
            if not r.o:
                assert r.n == run(r.value, False, sep)[1], r
    long = spark.createDataFrame([('"' + "a" * 10 + '""' * 200_000 + "x,b",), ('"x",' * 100_000,)], "value string")
    assert [tuple(r) for r in long.select(opens(F.col("value"), ","), field_count(F.col("value"), ",")).collect()][1] == (False, 100_001)


def test_a_day_of_ones_own_hides_no_rows(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-05 10:00:00' as timestamp, date'2024-01-09' as day, 1 as id")
    plain, by_day = str(tmp_path / "plain"), str(tmp_path / "by_day")
    rows.write.parquet(plain)
    rows.write.partitionBy("day").parquet(by_day)
    for path in (plain, by_day):
        assert sources.load_flows_parquet(spark, path, date_filter=("2024-01-05", "2024-01-06")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_flows(rows, str(tmp_path / "own"), "timestamp")
    stored = sinks.write_flows(rows.drop("day"), str(tmp_path / "stored"), "timestamp")
    again = sinks.write_flows(spark.read.parquet(stored), str(tmp_path / "again"), "timestamp")
    assert sources.load_flows_parquet(spark, again, date_filter=("2024-01-05", "2024-01-06")).count() == 1
    # Rewritten with another day in a plain file: the mark alone is not believed.
    spark.read.parquet(stored).withColumn("day", F.lit("2024-02-01").cast("date")).write.parquet(str(tmp_path / "moved"))
    assert sources.load_flows_parquet(spark, str(tmp_path / "moved"), date_filter=("2024-01-05", "2024-01-06")).count() == 1


def test_usage_reads_the_flows_once(spark, sf_dir):
    from flowlens import fixtures
    from flowlens.plans.rules import rule_usage

    df = rule_usage(fixtures.flows_large(spark, sf_dir))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "Window" not in plan
