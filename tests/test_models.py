"""Batch models and the reading of their answers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from parleyframe.operators import models
from parleyframe.operators.models import Model


def parsed(spark, answer, strict=False):
    frame = spark.createDataFrame(
        [("e", 1, answer)], "episode_id string, pass int, response string")
    rows = models.parse_proposals(frame, strict).orderBy("pos").collect()
    return [(r.speaker_id, r.proposed_name, r.confidence, r.justification) for r in rows]


A = {"speaker_id": "A", "proposed_name": " Ann ", "confidence": 0.5, "justification": " j\n"}


@pytest.mark.parametrize("answer,expected", [
    (json.dumps([A]), [("A", "Ann", 0.5, "j")]),
    (f"\n {json.dumps([A])} \n", [("A", "Ann", 0.5, "j")]),
    ('[1,{"speaker_id":"A","confidence":"0.4"}]', [("A", "UNKNOWN", 0.4, "")]),
    (json.dumps([A]) + " as asked", []),
    (f"```json\n{json.dumps([A])}\n```", []),
    ('[{"speaker_id":"A","confidence":null}]', []),
    ('[{"speaker_id":"A","confidence":"high"}, {"speaker_id":"B"}]', [("B", "UNKNOWN", 0.0, "")]),
    ('[{"proposed_name":"Ann"}]', []),
    ('[{"speaker_id":null,"proposed_name":null}]', [("None", "None", 0.0, "")]),
    ('[{"speaker_id":7,"proposed_name":true,"justification":[1]}]', [("7", "True", 0.0, "[1]")]),
    ('[{"speaker_id":"A","speaker_id":"B"}]', [("B", "UNKNOWN", 0.0, "")]),
    ("[{'speaker_id':'A'}]", []),
    ('{"speaker_id":"A"}', []), ('"text"', []), ("", []), ("[]", []), ("[[1], null]", []),
])
def test_answers(spark, answer, expected):
    assert parsed(spark, answer) == expected


def test_nan_confidence_is_read(spark):
    (row,) = parsed(spark, '[{"speaker_id":"A","confidence":NaN}]')
    assert row[2] != row[2]


@pytest.mark.parametrize("answer", ["5", "null", "true"])
def test_bare_answers(spark, answer):
    assert parsed(spark, answer) == []
    with pytest.raises(Exception, match="not a list"):
        parsed(spark, answer, strict=True)


def test_http_model(spark, rows):
    asked = []

    class Endpoint(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            reply = {} if body["ask"] == "none" else {"response": body["ask"].upper()}
            self.send_response(500 if body["ask"] == "fail" else 200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/generate"
        model = models.http_text_model(
            "m", url, lambda prompt: {"ask": prompt}, lambda reply: reply.get("response", ""))
        prompts = spark.createDataFrame([("a", "hi"), ("b", "none")], "id string, prompt string")
        answers = models.generate(prompts, model, concurrency=2)
        assert rows(answers) == [("a", "hi", "HI"), ("b", "none", "")]
        assert sorted(a["ask"] for a in asked) == ["hi", "none"]
        with pytest.raises(Exception, match="500"):
            models.generate(prompts.withColumn("prompt", F.lit("fail")), model).collect()
    finally:
        server.shutdown()


def test_model_is_loaded_once_per_worker(spark):
    def load():
        import os
        import uuid
        mark = f"{os.getpid()}:{uuid.uuid4()}"
        return lambda prompt: mark
    prompts = spark.range(64).select(F.col("id").cast("string").alias("prompt")).repartition(16)
    marks = {r.response for r in models.generate(prompts, Model("once", load)).collect()}
    assert len({m.split(":")[0] for m in marks}) == len(marks)


def test_answers_are_read_once(spark):
    """However many readers the settled proposals have, Python reads each answer once."""
    frame = spark.createDataFrame(
        [("e", 1, json.dumps([A]))], "episode_id string, pass int, response string")
    plan = models.parse_proposals(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def load_marking(folder, fail_on):
    """Echo that leaves a file a prompt, and fails the first time it sees one of them."""
    import os
    import uuid

    def load():
        def ask(prompt):
            open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
            seen = sum(name.startswith(f"{prompt}-") for name in os.listdir(folder))
            if prompt == fail_on and seen <= 1:
                raise ValueError("lost")
            return prompt.upper()
        return ask
    return load


def test_answers_outlive_a_failure(spark, rows, tmp_path):
    from collections import Counter
    (tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame(
        [(i, f"p{i % 30}") for i in range(45)] + [(99, None)], "i int, prompt string")
    table = str(tmp_path / "answers")
    model = Model("marking", load_marking(str(tmp_path / "calls"), "p7"))

    def run(some_model=model):
        return rows(models.generate_into(prompts, some_model, table, at_once=10), "i", "response")
    expected = sorted([(i, f"P{i % 30}") for i in range(45)] + [(99, None)], key=repr)
    with pytest.raises(Exception, match="lost"):
        run()
    before = Counter(f.name.split("-")[0] for f in (tmp_path / "calls").iterdir())
    kept = {r.response for r in models.answers_in(spark, table).collect()}
    assert run() == expected
    after = Counter(f.name.split("-")[0] for f in (tmp_path / "calls").iterdir())
    assert max(after.values()) <= 2
    assert all(after[p.lower()] == before[p.lower()] for p in kept)
    # All are answered now; another model has answers of its own.
    assert run() == expected
    assert Counter(f.name.split("-")[0] for f in (tmp_path / "calls").iterdir()) == after
    assert run(Model("other", load_marking(str(tmp_path / "calls"), None))) == expected
    assert models.answers_in(spark, table).count() == 60


def load_counting():
    class Answer(str):
        """A text that counts the answers a worker holds."""
        held = 0

        def __new__(cls, _):
            Answer.held += 1
            return str.__new__(cls, Answer.held)

        def __del__(self):
            Answer.held -= 1
    return Answer


def test_few_answers_are_held_at_once(spark):
    prompts = spark.range(500).coalesce(1).selectExpr("cast(id as string) as prompt", "'old' as response")
    answered = models.generate(prompts, models.Model("counting", load_counting)).collect()
    assert [r.prompt for r in answered] == list(map(str, range(500)))
    assert max(int(r.response) for r in answered) <= 2 * models.TEXTS_AT_ONCE


def load_letters():
    return lambda text: [(c, "LETTER") for c in text]


def test_entities_of_many_texts(spark):
    table = spark.range(101).coalesce(1).selectExpr("cast(id as string) as name")
    found = models.with_entities(table, "name", models.Model("letters", load_letters)).collect()
    assert ["".join(e.text for e in r.entities) for r in found] == [r.name for r in found]
