"""Readers and writers over real files."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from parleyframe.sources import lines, rttm, segments, tables

GOOD = "SPEAKER e 1 2.0 3 <NA> <NA> S1 <NA> <NA>"


def parse(spark, *values, **options):
    frame = spark.createDataFrame(
        [("e", i, v) for i, v in enumerate(values)], "episode_id string, line_no long, value string")
    return rttm.parse_rttm(frame, **options)


def test_rttm_lines(spark, rows):
    found = parse(spark, "# note", "  ", GOOD, "  speaker e 1 2.0 3 <NA> <NA> S2 <NA>\t",
                  "SPEAKER e 1 5 -1 x x S3 x")
    assert rows(found) == [
        ("e", 2, 2.0, 5.0, "S1"), ("e", 3, 2.0, 5.0, "S2"), ("e", 4, 5.0, 4.0, "S3")]


BAD = ["SPEAKER e 1 x 3 <NA> <NA> S <NA>", "SPEAKER e 1 2 3 <NA> <NA> S", "LEXEME e 1 2 3 a b S c"]


@pytest.mark.parametrize("line", BAD)
def test_malformed_rttm(spark, rows, line):
    with pytest.raises(Exception, match="malformed speaker turn"):
        parse(spark, GOOD, line).collect()
    with pytest.raises(Exception, match="malformed speaker turn"):
        parse(spark, GOOD, line).count()
    assert rows(parse(spark, GOOD, line, mode=rttm.DROPMALFORMED)) == [("e", 0, 2.0, 5.0, "S1")]
    kept = rows(parse(spark, GOOD, line, mode=rttm.PERMISSIVE))
    assert kept == [("e", 0, 2.0, 5.0, "S1", None), ("e", 1, None, None, None, line)]


def test_exact_ends(spark):
    times = ["0.1 0.2", "1.010 0.320", "-0.1 .4", "1e-1 0.2", "0.1 inf", "+5. -4.9",
             "123456789012345678 0.25", "0.1234567890123456789 0", "1_0.1 0.2"]
    lines = [f"SPEAKER e 1 {x} <NA> <NA> S1 <NA> <NA>" for x in times]
    exact = [r.end for r in parse(spark, *lines, exact=True).orderBy("line_no").collect()]
    summed = [sum(map(float, x.split())) for x in times]
    assert exact == [0.3, 1.33, *summed[2:5], 0.1, *summed[6:]]
    assert [r.end for r in parse(spark, *lines).orderBy("line_no").collect()] == summed


def test_lines_of_split_files_are_numbered(spark, rows, tmp_path):
    texts = {f"ep{k}": [f"{k}:{i}:{'x' * (i % 40)}" for i in range(400 * k)] for k in (1, 2, 7)}
    for name, content in texts.items():
        newline = {"ep1": "\n", "ep2": "\r\n", "ep7": "\n"}[name]
        (tmp_path / f"{name}.v2.txt").write_text(newline.join(content), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        found = lines.numbered_lines(spark, str(tmp_path))
        ordered = lines.ordered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 3
        numbered = rows(found, "episode_id", "line_no", "value")
        inline = [(r.episode_id, r.value) for r in ordered.orderBy("episode_id", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = [(f"{name}.v2", i, line) for name, content in texts.items()
                for i, line in enumerate(content)]
    assert numbered == sorted(expected, key=repr)
    assert inline == [(e, v) for e, _, v in sorted(expected)]


TURNS = "episode_id string, start double, end double, speaker string"
SPOKEN = [("b 1", 3.0, 4.5, "S1"), ("b 1", 1.0, 2.25, "S0"), ("007", 0.0, 1.0, "S0")]


def test_rttm_round_trip_per_episode(spark, tmp_path):
    path = str(tmp_path / "out")
    rttm.write_rttm(spark.createDataFrame(SPOKEN, TURNS), path, per_episode=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("episode_id=007/*.txt")))
    assert text == "SPEAKER <NA> 1 0.000 1.000 <NA> <NA> S0 <NA> <NA>\n"
    back = rttm.read_rttm(spark, path, episodes="directory")
    found = [(r.episode_id, r.start, r.end, r.speaker)
             for r in back.orderBy("episode_id", "line_no").collect()]
    assert found == sorted(SPOKEN)


def test_rttm_round_trip_with_recordings(spark, tmp_path):
    path = str(tmp_path / "out")
    turns = spark.createDataFrame([(e.strip("b "), *rest) for e, *rest in SPOKEN], TURNS)
    rttm.write_rttm(turns, path)
    back = rttm.read_rttm(spark, path, episodes="line").orderBy("episode_id", "line_no")
    assert [(r.episode_id, r.start) for r in back.collect()] == [("007", 0.0), ("1", 1.0), ("1", 3.0)]
    with pytest.raises(Exception, match="cannot be a recording"):
        rttm.write_rttm(spark.createDataFrame(SPOKEN, TURNS), str(tmp_path / "other"))


def test_json_array_files(spark, rows, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(
        [{"start": 1, "end": "2.5", "text": " a\n", "extra": 1},
         {"start": 3.25, "end": 4, "text": "é \"q\""}], indent=4))
    (tmp_path / "two.json").write_text("[]")
    (tmp_path / "three.json").write_text('\n [{"text": "z", "end": 1e1, "start": 0}]')
    assert rows(segments.read_transcript(spark, str(tmp_path), 2, "array")) == [
        ("one", 0, 0.5, 1.25, " a\n"), ("one", 1, 1.625, 2.0, "é \"q\""), ("three", 0, 0.0, 5.0, "z")]


@pytest.mark.parametrize("content", [
    '[{"start": 1, "text": "a"}]', '[{"start": 1, "end": "x", "text": "a"}]',
    '[{"start": 1, "end": 2}]', '{"start": 1, "end": 2, "text": "a"}', '[{"start": 1, ', ' \n',
    '[{"start": 1, "end": 2, "text": "a"}\n{"start": 1, "end": 2, "text": "a"}]',
    '[{"start": 1, "end": 2, "text": "a"},\n]', '[\n,\n]', '[]\n[]',
    '[{"start": 1, "end": 2, "text": "a"}\n]\nx', '[{"start": 1, "end": 2, "text": "a\nb"}]'])
def test_unusable_json_fails(spark, tmp_path, content):
    (tmp_path / "bad.json").write_text(content)
    with pytest.raises(Exception):
        segments.read_transcript(spark, str(tmp_path), layout="array").collect()


NASTY = ["plain", 'a "quote" and \\', "[{", "}],", "\\\"", "line\nend", "é\u2028 🙂", "", ",", "x" * 3000]


@pytest.mark.parametrize("style", ["indented", "flat", "line each", "leading commas"])
def test_arrays_are_read_in_splits(spark, rows, tmp_path, style):
    """Any splits give what the file gives as a whole."""
    said = {f"e{k}": [{"start": i / 2, "end": i / 2 + 1, "text": NASTY[i % len(NASTY)],
                       "more": {"words": [i, {"deep": [NASTY[-i % len(NASTY)]]}]}}
                      for i in range(n)] for k, n in enumerate([0, 1, 2, 150])}
    for name, content in said.items():
        text = {
            "indented": lambda: json.dumps(content, indent=2, ensure_ascii=False),
            "flat": lambda: json.dumps(content),
            "line each": lambda: "[\r\n" + ",\r\n".join(map(json.dumps, content)) + "\r\n\r\n]\r\n",
            "leading commas": lambda: "[" + "\n , ".join(map(json.dumps, content)) + "]"}[style]()
        (tmp_path / f"{name}.json").write_text(text, newline="")
    whole = segments.as_transcript(segments.parse_arrays(
        lines.whole_files(spark, str(tmp_path)), segments.SEGMENT_FIELDS))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        found = segments.read_transcript(spark, str(tmp_path), layout="array")
        assert rows(found) == rows(whole) == sorted(
            [(e, i, x["start"], x["end"], x["text"]) for e, c in said.items()
             for i, x in enumerate(c)], key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


UTTERANCES = "episode_id string, pos long, start double, end double, speaker string, text string"
SAID = [("e", 5, 1.0, 2.0, "S1", 'say "x"\n'), ("e", 2, 0.0, 1.0, "S0", "é"),
        ("f", 0, 0.5, 0.75, "S0", " pad ")]


@pytest.mark.parametrize("layout", ["records", "lines", "array"])
def test_segments_round_trip(spark, rows, tmp_path, layout):
    path = str(tmp_path / "out")
    segments.write_segments(spark.createDataFrame(SAID, UTTERANCES), path, layout=layout)
    if layout == "array":
        back = {}
        for folder in os.listdir(path):
            if folder.startswith("episode_id="):
                parts = sorted((tmp_path / "out" / folder).glob("*.txt"))
                back[folder[11:]] = json.loads("".join(p.read_text() for p in parts))
        assert back == {
            "e": [{"start": 0.0, "end": 1.0, "speaker": "S0", "text": "é"},
                  {"start": 1.0, "end": 2.0, "speaker": "S1", "text": 'say "x"\n'}],
            "f": [{"start": 0.5, "end": 0.75, "speaker": "S0", "text": " pad "}]}
    found = segments.read_utterances(spark, path, layout=layout, partitioned=layout != "records")
    if layout != "records":
        # Positions are counted anew from the order of the lines (an array's first is its bracket).
        first = int(layout == "array")
        places = {("e", 2): first, ("e", 5): first + 1, ("f", 0): first}
        expected = [(e, places[e, p], a, b, s, t.strip()) for e, p, a, b, s, t in SAID]
    else:
        expected = [(*rest, t.strip()) for *rest, t in SAID]
    assert rows(found) == sorted(expected, key=repr)


def test_record_limit_cuts_results_only(spark, tmp_path):
    """Tables between steps are whole, and arrays in many files bring no checksum files."""
    limit, path = "spark.sql.files.maxRecordsPerFile", str(tmp_path / "out")
    said = spark.range(30, numPartitions=1).selectExpr(
        "'e' episode_id", "id pos", "id * 1.0D start", "id + 1.0D end", "'S' speaker", "'t' text")
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tasks = spark.conf.get(listing)
    kept = spark.conf.get(limit)
    spark.conf.set(limit, 3)
    try:
        with lines.settled_while(said, "lines") as rows:
            assert len(rows.inputFiles()) == 1
        segments.write_segments(said, path, layout="array")
    finally:
        spark.conf.set(limit, kept)
    names = os.listdir(tmp_path / "out" / "episode_id=e")
    assert len([n for n in names if n.endswith(".txt")]) >= 11
    assert [n for n in names if n.endswith(".crc")] == []
    found = segments.read_utterances(spark, path, layout="array", partitioned=True)
    assert found.orderBy("pos").select("start").collect() == said.select("start").collect()
    assert spark.conf.get(listing) == tasks


def test_small_files_are_read_in_few_tasks(spark, rows, tmp_path, monkeypatch):
    """Lines of 600 files are settled in files a core, not one for every 32."""
    settled, kept = [], spark.conf.get("spark.sql.files.openCostInBytes")
    settle = lines.settle
    monkeypatch.setattr(lines, "settle", lambda *a: settled.append(settle(*a)) or settled[-1])
    for k in range(600):
        (tmp_path / f"e{k}.json").write_text(f"a{k}\nb{k}\n")
    found = lines.numbered_lines(spark, str(tmp_path))
    assert len(settled[0].inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    assert rows(found, "episode_id", "line_no", "value") == sorted(
        ((f"e{k}", n, f"{c}{k}") for k in range(600) for n, c in enumerate("ab")), key=repr)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == kept


def test_null_fields_are_written(spark):
    frame = spark.createDataFrame([("a", None)], "text string, speaker string")
    line = frame.select(segments.segment_json(["speaker", "text"]).alias("x")).first().x
    assert json.loads(line) == {"speaker": None, "text": "a"}


def test_spoken_order_is_stable_by_start(spark):
    frame = spark.createDataFrame(
        [("e", 2, 1.0), ("e", 0, 1.0), ("e", 1, 0.5)], "episode_id string, pos long, start double")
    assert [r.pos for r in segments.in_spoken_order(frame).collect()] == [1, 0, 2]


def test_settled_tables_are_computed_once(spark):
    frame = spark.range(20).select("id", F.rand().alias("x"))
    settled = tables.settle(frame, "test")
    assert settled.collect() == settled.collect()
    assert "Scan parquet" in settled._jdf.queryExecution().toString()


class Session:
    """The parts of a session that decide on the working folder."""

    def __init__(self, master, **settings):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(
            get=lambda name, default: settings.get(name, default), set=settings.__setitem__)


def test_working_folder_is_the_sessions(tmp_path):
    named = Session("spark://host", **{"spark.checkpoint.dir": str(tmp_path)})
    assert tables.working_folder(named) == str(tmp_path)
    own = Session("local[2]", **{tables.FOLDER: "/shared"})
    assert tables.working_folder(own) == "/shared"
    for master in ("spark://host", "local[2]"):
        with pytest.raises(ValueError, match="share"):
            tables.working_folder(Session(master))
