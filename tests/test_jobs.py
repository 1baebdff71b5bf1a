"""Jobs end to end with deterministic models."""

import json

import numpy as np
import pytest

from parleyframe.functions.prompts import SECOND_ROUND as RETRY_NOTE
from parleyframe.operators.models import Model
from parleyframe.plans import jobs
from parleyframe.schemas import Settings
from parleyframe.sources.tables import load_reference
from tests.test_audio import pcm

RATE, BLOCK = 8, 16


def test_assign_files(spark, tmp_path):
    (tmp_path / "t").mkdir(), (tmp_path / "r").mkdir()
    (tmp_path / "t" / "ep1.json").write_text(json.dumps(
        [{"start": 0, "end": 4, "text": "one"}, {"start": 9, "end": 10, "text": "two"}]))
    (tmp_path / "r" / "ep1.rttm").write_text(
        "# turns\nSPEAKER x 1 0 2 <NA> <NA> A <NA> <NA>\n\nSPEAKER x 1 2 2 <NA> <NA> B <NA> <NA>\n")
    own = {"layout": "array", "rttm_episodes": "file"}
    jobs.assign_files(spark, str(tmp_path / "t"), str(tmp_path / "r"), str(tmp_path / "out"), **own)
    (part,) = (tmp_path / "out" / "episode_id=ep1").glob("*.txt")
    assert json.loads(part.read_text()) == [
        {"start": 0.0, "end": 4.0, "speaker": "A", "text": "one"},
        {"start": 9.0, "end": 10.0, "speaker": "UNKNOWN", "text": "two"}]
    (tmp_path / "t" / "ep2.json").write_text('[{"start": 0, "end": 4, "text": "one"}]')
    with pytest.raises(Exception, match="no diarization segments for episode ep2"):
        jobs.assign_files(
            spark, str(tmp_path / "t"), str(tmp_path / "r"), str(tmp_path / "out2"), **own)


def test_turns_that_end_together_tie(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"episode_id": "x", "pos": 0, "start": 0.1, "end": 1, "text": "one"}')
    # As doubles 0.1 and 0.2 make more than 0.3.
    (tmp_path / "r.rttm").write_text("".join(
        f"SPEAKER x 1 {span} <NA> <NA> {speaker} <NA> <NA>\n"
        for span, speaker in [("0.000 0.300", "A"), ("0.100 0.200", "B")]))
    said = jobs.assign_files(
        spark, str(tmp_path / "t.json"), str(tmp_path / "r.rttm"), str(tmp_path / "out"))
    assert [r.speaker for r in said.collect()] == ["A"]


UTTERANCES = "episode_id string, pos long, start double, end double, speaker string, text string"
EPISODES = "episode_id string, name string, description string, duration_ms long"

# What the model answers, by show and round: an omitted speaker, an invented
# one, a clash, a confident UNKNOWN, an answer that is not JSON.
ANSWERS = {
    ("Clash", 1): [("A", "Ann", .9), ("B", "ann", .95), ("C", "Cy", .9)],
    ("Clash", 2): [("A", "Amy", .85), ("B", "Bea", .97)],
    ("Omits", 1): [("A", "Ann", .9), ("ghost", "Gus", .2)],
    ("Omits", 2): [("B", "Bob", .99)],
    ("Low", 1): [("A", "Ann", .3), ("B", "UNKNOWN", .8), ("A", "Abe", .6)],
    ("Low", 2): [("A", "Ada", .6)],
    ("Broken", 1): None,
}


def load_table():
    def answer(prompt):
        show = prompt.split("Title: ")[1].split(" - ")[0]
        again = 2 if RETRY_NOTE in prompt else 1
        shown = [line[9:] for line in prompt.split("\n") if line.startswith("Speaker: ")]
        rows = ANSWERS[show, again]
        if rows is None:
            return "no idea"
        return json.dumps([
            {"speaker_id": s, "proposed_name": n, "confidence": c, "justification": ",".join(shown)}
            for s, n, c in rows])
    return answer


def test_infer_names(spark):
    shows = ["Clash", "Omits", "Low", "Broken"]
    said = spark.createDataFrame(
        [(show, i, i * 2.0, i * 2.0 + 1, "CBA"[i % 3], f"t{i}") for show in shows for i in range(6)],
        UTTERANCES)
    episodes = spark.createDataFrame([(s, f"{s} - 1", "d", 0) for s in shows], EPISODES)
    result = jobs.infer_names(said, episodes, Model("table", load_table), hosts=["Al"])
    names = {(r.episode_id, r.speaker_id): (r.proposed_name, r.confidence, r.justification)
             for r in result.assignments.collect()}
    assert names == {
        # Both clashing speakers are asked again, in order of first proposal; the
        # retry only counts where it is more confident.
        ("Clash", "A"): ("Ann", .9, "C,B,A"), ("Clash", "B"): ("Bea", .97, "A,B"),
        ("Clash", "C"): ("Cy", .9, "C,B,A"),
        # B and C were never proposed, so nobody asks again about them; the
        # unresolved ghost has no profile and hence no second prompt.
        ("Omits", "A"): ("Ann", .9, "C,B,A"), ("Omits", "ghost"): ("UNKNOWN", .2, "C,B,A"),
        ("Low", "A"): ("UNKNOWN", .6, "C,B,A"), ("Low", "B"): ("UNKNOWN", .8, "C,B,A")}
    labelled = {(r.episode_id, r.pos): (r.speaker, r.speaker_name, r.confidence)
                for r in result.labelled.collect()}
    assert len(labelled) == 24
    assert labelled["Clash", 4] == ("B", "Bea", .97)
    assert labelled["Omits", 0] == ("C", "UNKNOWN", 0.0)
    assert labelled["Broken", 2] == ("A", "UNKNOWN", 0.0)


def test_strict_inference_refuses_invented_speakers(spark):
    said = spark.createDataFrame([("Omits", 0, 0.0, 1.0, "A", "t")], UTTERANCES)
    episodes = spark.createDataFrame([("Omits", "Omits - 1", "d", 0)], EPISODES)
    with pytest.raises(Exception, match="no profile for speaker ghost"):
        jobs.infer_names(said, episodes, Model("table", load_table), strict=True)


def test_single_pass(spark):
    said = spark.createDataFrame([("Clash", 0, 0.0, 1.0, "A", "t")], UTTERANCES)
    episodes = spark.createDataFrame([("Clash", "Clash - 1", "d", 0)], EPISODES)
    result = jobs.infer_names(
        said, episodes, Model("table", load_table), settings=Settings(max_passes=1))
    assert {r.speaker_id: r.proposed_name for r in result.assignments.collect()} == {
        "A": "Ann", "B": "ann", "C": "Cy"}


def load_note_reader():
    def name(prompt):
        again = RETRY_NOTE in prompt
        return json.dumps([{"speaker_id": "A", "proposed_name": "Ann", "confidence": .9 if again
                            else .1, "justification": prompt.split("Candidate Names: ")[1][:27]}])
    return name


def test_episode_without_metadata(spark):
    said = spark.createDataFrame([("lost", 0, 0.0, 1.0, "A", "t")], UTTERANCES)
    episodes = spark.createDataFrame([], EPISODES)
    result = jobs.infer_names(said, episodes, Model("note", load_note_reader))
    (row,) = result.assignments.collect()
    assert (row.proposed_name, row.justification) == ("Ann", "Unknown Guest, Unknown Host")


# Audio whose every two seconds are one voice: a constant level per speaker.
LEVELS = (0.1, 0.5, 0.9)


def wave(speakers):
    return np.repeat([LEVELS[s] for s in speakers], 2 * RATE)


def load_detector():
    def detect(samples, rate, num_speakers):
        return [(2.0 * k, 2.0 * k + 2, f"{x:.1f}/{num_speakers}")
                for k, x in enumerate(samples[::2 * rate])]
    return detect


def load_embedder():
    def embed(samples, rate):
        x = float(np.mean(samples))
        return [np.cos(1.5 * x), np.sin(1.5 * x)]
    return embed


DETECTOR, EMBEDDER = Model("levels", load_detector), Model("angles", load_embedder)


@pytest.mark.parametrize("wanted", [None, 3])
def test_diarize(spark, tmp_path, wanted):
    voices = {"x": [2, 0, 1, 2, 0, 0, 1, 1, 2, 0, 2], "y": [1, 0, 2, 1, 1, 0, 2, 2]}
    settings = Settings(chunk_minutes=8 / 60, overlap_seconds=2, num_speakers=wanted)
    path = str(tmp_path / "voices")
    table = pcm(spark, {e: [wave(v), wave(v)] for e, v in voices.items()}, BLOCK, RATE)
    turns = jobs.diarize(table, DETECTOR, EMBEDDER, BLOCK, settings, path)
    found = sorted((r.episode_id, r.start, r.end, r.speaker) for r in turns.collect())
    # Speakers are numbered by first turn of the first window.
    assert found == sorted(
        (e, 2.0 * i, 2.0 * i + 2, f"SPEAKER_{list(dict.fromkeys(v)).index(s):02d}")
        for e, v in voices.items() for i, s in enumerate(v))
    reference = load_reference(spark, path)
    assert sorted((r.episode_id, r.turn_pos) for r in reference.collect()) == [
        (e, i) for e in "xy" for i in range(4)]


def load_speech():
    return lambda samples, rate: [
        (100 * k, 100 * k + 100, f" {x:.1f} ") for k, x in enumerate(samples[::rate])]


def load_namer():
    def name(prompt):
        shown = [line[9:] for line in prompt.split("\n") if line.startswith("Speaker: ")]
        return json.dumps([
            {"speaker_id": s, "proposed_name": f"Person {s[-1]}", "confidence": .9} for s in shown])
    return name


def test_corpus(spark):
    table = pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 1])]}, BLOCK, RATE)
    episodes = spark.createDataFrame([("x", "Show - 1", "about", 12000)], EPISODES)
    result = jobs.process_corpus(
        table, episodes, Model("speech", load_speech), DETECTOR, EMBEDDER, Model("namer", load_namer),
        BLOCK, settings=Settings(chunk_minutes=8 / 60, overlap_seconds=2), window_minutes=6 / 60,
        overlap_seconds=2)
    rows = result.labelled.orderBy("start").collect()
    assert [(r.start, r.text, r.speaker_name) for r in rows] == [
        (float(i), f"{LEVELS[s]:.1f}", f"Person {'201'.index(str(s))}")
        for i, s in enumerate(np.repeat([2, 0, 1, 2, 0, 1], 2).tolist())]


def test_files_from_audio_to_names(spark, tmp_path):
    """Every job through its files, as separate runs would be."""
    paths = {n: str(tmp_path / n) for n in ("pcm", "text", "turns", "said", "named")}
    pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 1])]}, BLOCK, RATE).write.parquet(paths["pcm"])
    settings = Settings(chunk_minutes=8 / 60, overlap_seconds=2)
    jobs.transcribe_files(spark, paths["pcm"], paths["text"], Model("speech", load_speech), BLOCK)
    jobs.diarize_files(spark, paths["pcm"], paths["turns"], DETECTOR, EMBEDDER, BLOCK, settings)
    jobs.assign_files(spark, paths["text"], paths["turns"], paths["said"])
    episodes = spark.createDataFrame([("x", "Show - 1", "about", 12000)], EPISODES)
    names = jobs.infer_files(spark, paths["said"], paths["named"], episodes,
                             Model("namer", load_namer))
    assert {r.speaker_id: r.proposed_name for r in names.collect()} == {
        f"SPEAKER_{i:02d}": f"Person {i}" for i in range(3)}
    named = sorted(spark.read.json(paths["named"]).collect(), key=lambda r: r.start)
    assert [(r.text, r.speaker_name) for r in named] == [
        (f"{LEVELS[s]:.1f}", f"Person {'201'.index(str(s))}")
        for s in np.repeat([2, 0, 1, 2, 0, 1], 2).tolist()]


def test_audio_beyond_its_length_fails(spark):
    table = pcm(spark, {"x": [wave([0, 1, 2, 0, 1, 2])]}, BLOCK, RATE)
    lengths = spark.createDataFrame([("x", 3000)], "episode_id string, duration_ms long")
    settings = Settings(chunk_minutes=4 / 60, overlap_seconds=1)
    with pytest.raises(Exception, match="no window holds it"):
        jobs.diarize(table, DETECTOR, EMBEDDER, BLOCK, settings, lengths=lengths).collect()


def load_late_detector():
    def detect(samples, rate, num_speakers):
        return [t for t in load_detector()(samples, rate, num_speakers) if not t[2].startswith("0.1")]
    return detect


@pytest.mark.parametrize("wanted", [None, 2])
def test_a_silent_first_window_loses_nothing(spark, wanted):
    table = pcm(spark, {"x": [wave([0, 0, 0, 0, 1, 2, 1, 2])], "y": [wave([1, 2, 1, 2])]}, BLOCK, RATE)
    settings = Settings(chunk_minutes=8 / 60, overlap_seconds=2, num_speakers=wanted)
    turns = jobs.diarize(table, Model("late", load_late_detector), EMBEDDER, BLOCK, settings).collect()
    assert sorted((r.start, r.speaker) for r in turns if r.episode_id == "x") == [
        (2.0 * k, "UNKNOWN") for k in range(4, 8)]
    assert len([r for r in turns if r.episode_id == "y"]) == 4


def test_each_input_is_parsed_once(spark, tmp_path):
    """Everything after the settled copies reads those."""
    said = spark.createDataFrame([("x", 0, 0.0, 1.0, "t")],
                                 "episode_id string, pos long, start double, end double, text string")
    turns = spark.createDataFrame([("x", 0, 0.0, 1.0, "A")],
                                  "episode_id string, line_no long, start double, end double, speaker string")
    path = str(tmp_path / "said")
    said.write.json(path)
    read = spark.read.schema(said.schema).json(path)
    plan = jobs.assign(read, turns, strict=True)._jdf.queryExecution().executedPlan().toString()
    assert "json" not in plan.lower().replace("parquet", "")


def test_run_folder_can_be_dropped(spark, tmp_path):
    from parleyframe.sources.tables import drop_folder
    folder = str(tmp_path / "run")
    table = pcm(spark, {"x": [wave([0, 1])]}, BLOCK, RATE)
    jobs.diarize(table, DETECTOR, EMBEDDER, BLOCK, folder=folder).collect()
    assert any((tmp_path / "run").iterdir())
    drop_folder(spark, folder)
    assert not (tmp_path / "run").exists()


def load_deaf():
    return lambda samples, rate, num_speakers: []


def test_windows_without_turns(spark):
    table = pcm(spark, {"x": [wave([0, 1])]}, BLOCK, RATE)
    deaf = Model("deaf", load_deaf)
    assert jobs.diarize(table, deaf, EMBEDDER, BLOCK).count() == 0
    with pytest.raises(ValueError, match="no turns"):
        jobs.diarize(table, deaf, EMBEDDER, BLOCK, strict=True)


def test_clipped_transcript(spark):
    table = pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 1])]}, BLOCK, RATE)
    settings = Settings(clip_audio=True, clip_start_sec=3, clip_duration_sec=4, sample_rate=RATE)
    rows = jobs.transcribe(table, Model("speech", load_speech), BLOCK, settings).collect()
    assert sorted((r.start, r.text) for r in rows) == [
        (0.0, "0.1"), (1.0, "0.5"), (2.0, "0.5"), (3.0, "0.9")]


def test_readme_example(spark, tmp_path):
    """The chain of file jobs as the README prints it, over two episodes."""
    import pathlib
    import re
    text = (pathlib.Path(__file__).parent.parent / "README.md").read_text()
    code = re.search(r"```python\n(.*?)```", text, re.S)[1]
    code = re.sub(r'"(\w+)/"', lambda m: repr(f"{tmp_path}/{m[1]}/"), code)
    waves = {"x": [wave([2, 0, 1, 2, 0, 1])], "y": [wave([1, 0])]}
    pcm(spark, waves, BLOCK, RATE).write.parquet(f"{tmp_path}/pcm/")
    episodes = spark.createDataFrame(
        [("x", "Show - 1", "about", 12000), ("y", "Show - 2", "", 4000)], EPISODES)
    exec(code, {
        "spark": spark, "speech": Model("speech", load_speech), "detector": DETECTOR,
        "embedder": EMBEDDER, "namer": Model("namer", load_namer), "episodes": episodes,
        "block_samples": BLOCK})
    named = spark.read.json(f"{tmp_path}/named/").collect()
    assert sorted((r.episode_id, r.start, r.text, r.speaker_name) for r in named) == sorted(
        (e, float(i), f"{LEVELS[s]:.1f}", f"Person {list(dict.fromkeys(v)).index(s)}")
        for e, v in (("x", [2, 0, 1, 2, 0, 1]), ("y", [1, 0]))
        for i, s in enumerate(np.repeat(v, 2).tolist()))


def counting(model, folder):
    """The same model; every call leaves a file in ``folder``."""
    import os
    import uuid

    def load():
        call = model.load()

        def counted(*arguments):
            open(os.path.join(folder, f"{model.name}-{uuid.uuid4().hex}"), "w").close()
            return call(*arguments)
        return counted
    return Model(f"{model.name} counted in {folder}", load)


@pytest.mark.parametrize("layout", ["records", "lines", "array"])
def test_a_window_is_heard_once(spark, tmp_path, layout):
    """Whatever the layout of the files, the speech model is asked once a window."""
    (tmp_path / "calls").mkdir()
    pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 1])], "y": [wave([1, 1])]}, BLOCK, RATE).write.parquet(
        str(tmp_path / "pcm"))
    model = counting(Model("speech", load_speech), str(tmp_path / "calls"))
    jobs.transcribe_files(spark, str(tmp_path / "pcm"), str(tmp_path / "text"), model, BLOCK,
                          window_minutes=6 / 60, layout=layout, overlap_seconds=2)
    # Windows start every four seconds of 12 and of 4.
    assert len(list((tmp_path / "calls").iterdir())) == 3 + 1
    from parleyframe.sources.segments import read_transcript
    rows = read_transcript(spark, str(tmp_path / "text"), layout=layout,
                           partitioned=layout != "records").collect()
    assert sorted((r.episode_id, r.start, r.text) for r in rows) == sorted(
        (e, float(i), f"{LEVELS[s]:.1f}") for e, v in (("x", [2, 0, 1, 2, 0, 1]), ("y", [1, 1]))
        for i, s in enumerate(np.repeat(v, 2).tolist()))


def test_turns_are_written_from_one_computation(spark, tmp_path):
    from parleyframe.sources.rttm import read_rttm, write_rttm
    (tmp_path / "calls").mkdir()
    ask = counting(Model("echo", lambda: lambda prompt: prompt), str(tmp_path / "calls"))
    from parleyframe.operators.models import generate
    turns = generate(spark.createDataFrame(
        [("x", float(i), i + 1.0, f"S{i % 3}") for i in range(20)],
        "episode_id string, start double, end double, prompt string"), ask)
    write_rttm(turns.withColumnRenamed("response", "speaker"), str(tmp_path / "turns"))
    assert len(list((tmp_path / "calls").iterdir())) == 20
    assert read_rttm(spark, str(tmp_path / "turns")).count() == 20


def run_corpus(table, episodes, calls, folder, **changed):
    models = {
        "speech": Model("speech", load_speech), "detector": DETECTOR, "embedder": EMBEDDER,
        "namer": Model("namer", load_namer), **changed}
    models = {name: counting(model, str(calls)) for name, model in models.items()}
    result = jobs.process_corpus(
        table, episodes, models["speech"], models["detector"], models["embedder"],
        models["namer"], BLOCK, settings=Settings(chunk_minutes=8 / 60, overlap_seconds=2),
        window_minutes=6 / 60, overlap_seconds=2, folder=folder)
    return sorted((r.start, r.text, r.speaker_name) for r in result.labelled.collect())


def test_a_second_run_makes_no_model_call(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 1])]}, BLOCK, RATE).write.parquet(str(tmp_path / "pcm"))
    episodes = spark.createDataFrame([("x", "Show - 1", "about", 12000)], EPISODES)
    episodes.write.parquet(str(tmp_path / "episodes"))

    def run(**changed):
        before = {f.name for f in calls.iterdir()}
        rows = run_corpus(spark.read.parquet(str(tmp_path / "pcm")),
                          spark.read.parquet(str(tmp_path / "episodes")),
                          calls, str(tmp_path / "run"), **changed)
        asked = {f.name.split("-")[0] for f in calls.iterdir() if f.name not in before}
        return rows, asked

    first, asked = run()
    assert asked == {"speech", "levels", "angles", "namer"}
    assert run() == (first, set())
    # Another namer is asked, and only it.
    again, asked = run(namer=Model("other namer", load_namer))
    assert (again, asked) == (first, {"other namer"})
    # Changed audio is another input.
    pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 2])]}, BLOCK, RATE).write.mode("overwrite").parquet(
        str(tmp_path / "pcm"))
    changed, asked = run()
    assert changed != first and {"speech", "levels"} <= asked


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    table = pcm(spark, {"x": [wave([2, 0, 1, 2, 0, 1])]}, BLOCK, RATE)
    episodes = spark.createDataFrame([("x", "Show - 1", "about", 12000)], EPISODES)

    def load_broken():
        def fail(prompt):
            raise ValueError("the namer is down")
        return fail
    with pytest.raises(Exception, match="the namer is down"):
        run_corpus(table, episodes, calls, str(tmp_path / "run"), namer=Model("broken", load_broken))
    before = {f.name for f in calls.iterdir()}
    rows = run_corpus(table, episodes, calls, str(tmp_path / "run"))
    assert len(rows) == 12
    assert {f.name.split("-")[0] for f in calls.iterdir() if f.name not in before} == {"namer"}


def turns_file(folder, lines):
    folder.mkdir()
    (folder / "turns.rttm").write_text("\n".join(lines) + "\n")
    return str(folder)


TURN_LINES = [
    "SPEAKER x 1 0.0 2.0 <NA> <NA> A <NA> <NA>", "# a comment", "",
    "SPEAKER x 1 2.0 two <NA> <NA> B <NA> <NA>", "SPEAKER x 1 2.0", "TURN x 1 2 2 a b c d",
    "SPEAKER x 1 2.0 2.0 <NA> <NA> B <NA> <NA>"]


@pytest.mark.parametrize("folder", [None, "run"])
def test_left_out_lines_and_silent_episodes_are_counted(spark, tmp_path, folder):
    from parleyframe.sources.rttm import DROPMALFORMED, PERMISSIVE
    from parleyframe.sources.segments import SEGMENT_FIELDS, write_segments
    from parleyframe.sources.tables import Steps
    said = spark.createDataFrame(
        [("x", 0, 0.0, 2.0, "one"), ("x", 1, 2.0, 4.0, "two"), ("y", 0, 0.0, 1.0, "three")],
        "episode_id string, pos long, start double, end double, text string")
    write_segments(said, str(tmp_path / "text"), SEGMENT_FIELDS)
    turns = turns_file(tmp_path / "turns", TURN_LINES)
    expected = {"segments": {"segments": 3}, "speaker-turns": {"turns": 2, "malformed_lines": 3},
                "episodes-without-turns": {"episodes_without_turns": 1}}
    for number, mode in enumerate([DROPMALFORMED, PERMISSIVE, DROPMALFORMED]):
        # The third run takes over the tables of the first, and their counts.
        steps = Steps(spark, folder and str(tmp_path / folder))
        rows = jobs.assign_files(
            spark, str(tmp_path / "text"), turns, str(tmp_path / f"said{number}"),
            rttm_mode=mode, strict=False, folder=steps).collect()
        assert sorted((r.episode_id, r.pos, r.speaker) for r in rows) == [
            ("x", 0, "A"), ("x", 1, "B"), ("y", 0, "UNKNOWN")]
        assert steps.counts == expected
    with pytest.raises(Exception, match="no diarization segments"):
        jobs.assign_files(spark, str(tmp_path / "text"), turns, str(tmp_path / "strict"),
                          rttm_mode=DROPMALFORMED)


def load_careless():
    def answer(prompt):
        if "Speaker: C" in prompt:
            return "I cannot say"
        if "Speaker: D" in prompt:
            return '{"speaker_id": "D"}'
        return json.dumps([
            {"speaker_id": "A", "proposed_name": "Ann", "confidence": .9},
            {"speaker_id": "Z", "proposed_name": "Zoe", "confidence": .9},
            {"proposed_name": "nobody"}, 7, {"speaker_id": "B", "confidence": "high"}])
    return answer


@pytest.mark.parametrize("folder", [None, "run"])
def test_skipped_answers_are_counted(spark, tmp_path, folder):
    rows = [("x", 0, "A"), ("x", 1, "B"), ("y", 0, "C"), ("z", 0, "D")]
    spark.createDataFrame(
        [(e, p, float(p), p + 1.0, s, "words") for e, p, s in rows],
        "episode_id string, pos long, start double, end double, speaker string, text string",
    ).write.parquet(str(tmp_path / "said"))
    spark.createDataFrame(
        [(e, "Show", "", 1) for e in "xyz"], EPISODES).write.parquet(str(tmp_path / "about"))

    def run():
        return jobs.infer_names(
            spark.read.parquet(str(tmp_path / "said")), spark.read.parquet(str(tmp_path / "about")),
            Model("careless", load_careless), settings=Settings(max_passes=1),
            folder=folder and str(tmp_path / folder))
    first = run()
    assert first.counts == {
        "proposals-1": {"proposals": 2, "answers_not_json": 1, "answers_not_a_list": 1,
                        "elements_without_speaker": 2, "elements_without_confidence": 1},
        "answered": {"invented_speakers": 1, "speakers_left_out": 3}}
    assert {r.speaker: r.speaker_name for r in first.labelled.collect()} == {
        "A": "Ann", "B": "UNKNOWN", "C": "UNKNOWN", "D": "UNKNOWN"}
    if folder:
        assert run().counts == first.counts


@pytest.mark.parametrize("folder", [None, "run"])
def test_nothing_is_counted_as_nothing(spark, tmp_path, folder):
    empty = spark.createDataFrame(
        [], "episode_id string, pos long, start double, end double, speaker string, text string")
    about = spark.createDataFrame([], EPISODES)
    counts = jobs.infer_names(empty, about, Model("careless", load_careless),
                              folder=folder and str(tmp_path / folder)).counts
    assert set(counts) == {"proposals-1", "proposals-2", "answered"}
    assert not any(n for step in counts.values() for n in step.values())
