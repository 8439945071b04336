from pyspark.sql import functions as F

from pacemark.operators import logs
from pacemark.sources import text

BLOCK = """----- TestDFSIO ----- : {op}
           Date & time: Mon Mar  5 01:02:03 BRT 2018
       Number of files: 2
Total MBytes processed: {mb}
     Throughput mb/sec: 40.5
Average IO rate mb/sec: 41.25
 IO rate std deviation: 1.5
    Test exec time sec: 12.75

"""


def lines(spark, *texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "file int, line_id bigint, text string")


def test_report_blocks(spark, tmp_path):
    path = tmp_path / "report.log"
    path.write_text(BLOCK.format(op="write", mb="512.0") + BLOCK.format(op="read", mb="64.0"))
    got = text.report_blocks(spark, str(path)).orderBy("op").collect()
    assert [(r.op, r.n_files, r.total_mb, r.exec_s) for r in got] == [("read", 2, 64.0, 12.75), ("write", 2, 512.0, 12.75)]
    assert str(got[0].run_ts) and got[0].throughput == 40.5
    stamp = text.report_blocks(spark, str(path)).select(F.unix_seconds("run_ts")).first()[0]
    assert stamp == 1520222523  # 2018-03-05 04:02:03 UTC


def test_run_lines(spark):
    df = lines(
        spark, "------ PageRank benchmark ------", "Profile: large", "TeraGen #1 = 40 seg.", "TestDFSIO (DF) #3 = 412 seg.",
        "TestDFSIO-3600 #2 = 7 seg.", "[AF] TestDFSIO #4 = 8 seg.", "TestDFSIOe #5 = 9 seg.", "#6 = 10 sec.",
        "Spark HiBench (AF) #7 = 11 seg.", ">> Run 4 >> 97 s.", "", "junk",
    )
    good, bad = text.run_lines_with_headers(df, slice_col=None)
    got = [tuple(r) for r in good.orderBy("line_id").select(
        "benchmark", "phase", "checkpoint_s", "rep", "seconds", "profile").collect()]
    assert got == [
        ("TeraGen", None, None, 1, 40.0, "large"),
        ("TestDFSIO", "DF", None, 3, 412.0, "large"),
        ("TestDFSIO", None, 3600, 2, 7.0, "large"),
        ("TestDFSIO", "AF", None, 4, 8.0, "large"),
        ("TestDFSIOe", None, None, 5, 9.0, "large"),
        ("PageRank", None, None, 6, 10.0, "large"),
        ("Spark HiBench", "AF", None, 7, 11.0, "large"),
        ("PageRank", None, None, 4, 97.0, "large"),
    ]
    assert [r.text for r in bad.collect()] == ["junk"]
    seconds, malformed = text.equals_seconds(df)
    assert sorted(r.seconds for r in seconds.collect()) == [7, 8, 9, 10, 11, 40, 412]
    assert malformed.where(F.col("text").startswith(">>")).count() == 1


def test_last_tokens(spark):
    df = lines(spark, "  Test exec time sec: 1.5", "other 2.5", "Test exec nothing")
    good, bad = text.last_token_values(df, text.EXEC_MARK)
    assert [r.value for r in good.collect()] == [1.5]
    assert bad.count() == 1
    assert text.last_token_values(df)[0].count() == 2


def test_log_files_and_lines(spark, tmp_path):
    (tmp_path / "log-nn-1.txt").write_text("a\nRoll Edit Log\n")
    (tmp_path / "log-nn-12.txt").write_text("Roll Edit Log\nRoll Edit Log\n")
    (tmp_path / "log-nn-3.txt").write_text("")
    (tmp_path / "other.txt").write_text("Roll Edit Log\n")
    files = text.log_files(spark, str(tmp_path), text.NAMENODE_LOGS)
    assert sorted(r.file_no for r in files.collect()) == [1, 3, 12]
    got = text.log_lines(spark, str(tmp_path), text.NAMENODE_LOGS)
    counts = logs.pattern_counts(got, files, logs.CHECKPOINT_DONE, ["file", "file_no"])
    assert sorted((r.file_no, r.cnt) for r in counts.collect()) == [(1, 1), (3, 0), (12, 2)]
    assert logs.pattern_mean(counts).first().mean_cnt == 1.0
    assert logs.cumulative_mean(counts).first().mean_cnt == 2 / 3


def record(i, level="INFO", message="m"):
    return f"2020-01-01 00:00:{i:02d},000 [myid:7] - {level}  [main:Some@{i}] - {message}"


def test_records_in_a_split_file(spark, tmp_path):
    rows = ["early line"]
    for i in range(50):
        rows.append(record(i, "WARN" if i % 5 == 0 else "INFO"))
        rows += [f"\tat line {i}.{j}" for j in range(i % 5 == 0 and 3 or 0)]
    (tmp_path / "d.log").write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = text.log_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        numbered = text.number_lines(df).orderBy("line_no").collect()
        assert [r.text for r in numbered] == rows
        parsed = logs.number_records(df, text.LINE_ORDER, slice_col=text.LINE_SLICE)
        folded = logs.fold_records(parsed).orderBy("record_no").collect()
        texts = logs.record_texts(parsed).orderBy("record_no", "piece").collect()
        pieces = logs.record_texts(parsed, lines_per_piece=3).orderBy("record_no", "piece").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.record_no, r.n_more) for r in folded] == [(0, 1)] + [
        (i + 1, 3 if i % 5 == 0 else 0) for i in range(50)
    ]
    assert folded[1].level == "WARN" and folded[2].src_line == 1 and folded[2]["class"] == "Some"
    assert "\n".join(r.text for r in texts) == "\n".join(rows) == "\n".join(r.text for r in pieces)
    assert len(texts) == 51 and len(pieces) == 61
    assert texts[1].text.endswith("\tat line 0.0\n\tat line 0.1\n\tat line 0.2")


def test_sessions(spark):
    df = spark.createDataFrame(
        [(10, "Established session 0xab with timeout"), (25, "Expiring session 0xab, timeout"), (30, "other")],
        "t bigint, message string",
    )
    got = logs.sessions(logs.session_events(df), "session", "opened", "closed").collect()
    assert [tuple(r) for r in got] == [("0xab", 10, 25, 15)]


def test_step_table(spark):
    df = spark.createDataFrame([("{10:1,\n 20 : 2, -1:9}",)], "text string")
    assert sorted(map(tuple, text.step_table(df).collect())) == [(-1, 9), (10, 1), (20, 2)]


def test_report_blocks_without_empty_lines(spark, tmp_path):
    path = tmp_path / "report.log"
    joined = "some header\n" + (BLOCK.format(op="write", mb="1.0") + BLOCK.format(op="read", mb="2.0")).replace("\n\n", "\n")
    torn = BLOCK.format(op="append", mb="3.0").replace("BRT", "CET").replace("\n", "\n\n", 3)
    path.write_text(joined + torn)
    got = text.report_blocks(spark, str(path)).orderBy("total_mb").collect()
    assert [(r.op, r.total_mb, r.exec_s, r.run_ts is None) for r in got] == [
        ("write", 1.0, 12.75, False), ("read", 2.0, 12.75, False), ("append", 3.0, 12.75, True),
    ]
    texts = spark.createDataFrame([(1, joined), (2, torn), (3, "none"), (4, None)], "id int, text string")
    split = text.report_fields(text.split_reports(texts))
    assert sorted((r.id, r.op) for r in split.collect()) == [(1, "read"), (1, "write"), (2, "append")]


def test_reports_are_parted_once(spark, capsys):
    texts = spark.range(1).select("id", F.concat(F.lit("----- TestDFSIO ----- : read\n"), "id").alias("text"))
    text.split_reports(texts.repartition(1)).explain()
    assert capsys.readouterr().out.count("split(") == 1
