import hashlib
import math
import os
import random
import re

import regex

from parleyframe.llm import sanitise
from parleyframe.sources.tables import working_folder
from tests.llm.conftest import ODD

TEXTS = [
    "a@b.c_d@e.f", "x@y @z a@@b.c q@a.b@c.d", "1.2.3.4.5.6.7.8", "999.1.1.1 001.002.003.255 1.2.3.256",
    "12.34.56.78.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "é 4111111111111111 é",
    "+1 (555) 010-9999 and +123", "+49.30.1234567-", "++1 555 010 9999 1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "a.b+c%d@mail-1.example.com.\nb@c.de\n+1 555 010 99 99", "١٢٣.1.1.1", "\n\n x@y.z", "1234567 " * 300,
    "5" * 5000, "me@" + "a." * 2000 + "b", "+" + "1-" * 3000 + "2", "🙂 a@b.co 🙂 10.0.0.1"]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(value):
    return re.sub("[^0-9]", "", value)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(
        int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(plain(v)) <= 19 and luhn(plain(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(plain(v)) <= 15)]


def base(text):
    found = []
    for k, (kind, pattern, valid) in enumerate(PATTERNS):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}")
                  for m in re.finditer(pattern, text) if valid(m[0])]
    return [x for *_, x in sorted(found)]


def test_base(documents):
    texts = TEXTS + [t or "" for _, t in ODD] + [" ".join(TEXTS[:15])]
    rows = sanitise.digests(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = base(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert row["n_card"] == sum(x.startswith("card") for x in expected)


BETRAYED = [
    (k, f"Filler {word} common words\nThe zanzibar office of {word} writes to kim@corp.example today\nEnd")
    for k, word in enumerate(["alpha", "bravo", "delta", "gamma"])]
CLEAN = [(10 + k, f"The office writes common words today {w}\nof zanzibar nothing else")
         for k, w in enumerate(["one", "two", "six"])]
OTHERS = [(100 + k, f"Some common line number{k} of the office today") for k in range(60)]


def test_disclosing_terms(documents):
    docs = documents(BETRAYED + CLEAN + [(200 + k, BETRAYED[0][1]) for k in range(50)] + OTHERS)
    rows = {r["doc_id"]: r["spans"] for r in sanitise.digests(docs, generalise=0.7).collect()}
    text = BETRAYED[1][1]
    place = text.index("zanzibar")
    assert f"term:{place}:{place + 8}" in rows[1].split(",")
    assert f":{text.index('bravo', 20)}:" not in rows[1]  # one text is no evidence
    assert rows[10] == rows[11] == rows[100] == ""
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs, generalise=0.7).collect()}
    assert "[TERM] office" in clean[1] and "[EMAIL]" in clean[1] and "kim@" not in clean[1]
    assert clean[10] == CLEAN[0][1]


def test_words_of_lines_are_not_broadcast(spark):
    """Spark takes the words of a line for one row."""
    lines = spark.range(9).selectExpr("id a", "id b", "1 line", "'a b c' text", "0 start")
    values = spark.range(9).selectExpr(
        "id a", "id b", "1 line", "'email' kind", "0 begin", "1 end", "'v' value")
    shares = spark.range(1).selectExpr("'email' kind", "'v' value", "'abc' term", "0.9D share")
    plan = sanitise.term_spans(lines, values, shares)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in next(x for x in plan.split("\n") if "Join" in x)


def test_sanitise_keeps_rows_and_columns(odd):
    out = sanitise.sanitise(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == len(ODD)
    texts = [r["text"] for r in rows if r["doc_id"] == 10]
    assert texts == ["mail me at [EMAIL] or [IP], [PHONE]; [CARD]"]
    assert {r["text"] for r in rows if r["doc_id"] == 2} == {None}


def test_a_common_word_discloses_little(documents):
    rows = sanitise.digests(documents(BETRAYED + CLEAN + OTHERS)).collect()
    for row in rows:
        for span in row["spans"].split(","):
            assert not span.startswith("term") or "office" not in span


def test_empty_table(none):
    assert sanitise.digests(none).collect() == []
    assert sanitise.sanitise(none).collect() == []


def cut_by(text, listed):
    """The text without the merged spans, and how many those are, as a pattern of the output."""
    spans = sorted((int(b), int(e)) for _, b, e in (x.split(":") for x in listed.split(",") if x))
    merged = []
    for begin, end in spans:
        if merged and begin < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([begin, end])
    kept, at = [], 0
    for begin, end in merged:
        kept.append(re.escape(text[at:begin]))
        at = end
    return r"(\[EMAIL\]|\[IP\]|\[CARD\]|\[PHONE\]|\[TERM\]|)".join([*kept, re.escape(text[at:])])


def test_no_character_of_a_span_survives(documents):
    bracketed = [(300 + k, f"Filler {w}\nThe [zanzibar] office of {w} writes to kim@corp.example today")
                 for k, w in enumerate(["kilo", "lima"])]
    texts = dict(BETRAYED + CLEAN + OTHERS + bracketed + [
        (400, "call +33.1.42.68.53.00 or"), (401, "é🙂 +33.1.42.68.53.00a@b.co 🙂"),
        *((500 + k, t) for k, t in enumerate(TEXTS))])
    docs = documents(list(texts.items()))
    spans = {r["doc_id"]: r["spans"] for r in sanitise.digests(docs, generalise=0.7).collect()}
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs, generalise=0.7).collect()}
    for i, text in texts.items():
        assert re.fullmatch(cut_by(text, spans[i]), clean[i], re.DOTALL), (text, clean[i])
    assert clean[400] == "call [PHONE] or"
    assert "zanzibar" not in clean[300] + clean[301] and "term:" in spans[300]


WORD = regex.compile(r"(?<![\p{L}\p{N}])(?=\p{N}*+\p{L})[\p{L}\p{N}]{2,}")
ADDRESS = re.compile(PATTERNS[0][1])


def brute_terms(texts, support=3, generalise=0.8, remove=0.95):
    """Spans of terms by text, restated with loops over distinct texts."""
    def words(line):
        return {w.lower() for w in WORD.findall(ADDRESS.sub(" ", line))}

    texts, of_value, of_term, both = sorted(set(texts)), {}, {}, {}
    for text in texts:
        lines = text.split("\n")
        for word in set().union(*map(words, lines)):
            of_term[word] = of_term.get(word, 0) + 1
        near = {}
        for i, line in enumerate(lines):
            for kind, pattern, valid in PATTERNS:
                for m in re.finditer(pattern, line):
                    if valid(m[0]):
                        value = kind, plain(m[0]) if kind in ("card", "phone") else m[0].lower()
                        near.setdefault(value, set()).update(
                            *map(words, lines[max(0, i - 1):i + 2]))
        for value, some in near.items():
            of_value.setdefault(value, set()).add(text)
            for word in some:
                both[value, word] = both.get((value, word), 0) + 1
    shares = {}
    for (value, word), n in both.items():
        p = len(of_value[value]) / len(texts)
        if n >= support and p < 1:
            share = math.log(n / len(texts) / p / (of_term[word] / len(texts))) / -math.log(p)
            if share >= generalise:
                for text in of_value[value]:
                    at = shares.setdefault(text, {})
                    at[word] = max(share, at.get(word, 0))
    spans = {}
    for text, found in shares.items():
        hidden = ADDRESS.sub(lambda m: " " * len(m[0]), text)
        spans[text] = {
            f"{'reveal' if found[m[0].lower()] >= remove else 'term'}:{m.start()}:{m.end()}"
            for m in WORD.finditer(hidden) if m[0].lower() in found}
    return spans


def test_terms_against_brute_force(documents):
    pick = random.Random(4)
    people = [(f"{n} {s}", f"{n.lower()}@corp{k}.example") for k, (n, s) in enumerate(
        [("Kim", "Zanzibar"), ("Bo", "X7q"), ("Ana", "Li"), ("Joe", "Smith")])]
    fill = [f"w{chr(97 + k)}ord" for k in range(20)]
    texts = []
    for k in range(400):
        lines = [" ".join(pick.choices(fill, k=6)) for _ in range(pick.randint(1, 4))]
        if k % 8 < len(people) and pick.random() < 0.8:
            name, mail = people[k % 8]
            lines[pick.randint(0, len(lines)):0] = pick.choice(
                [[name, mail], [f"{name}: {mail}"], [f"{mail} and {name}", "x", name],
                 [mail, *[""] * (k % 8 < 2), name]])
        elif k % 50 == 7:
            lines.append(pick.choice(people[:2])[0])
        texts.append("\n".join(lines))
    texts += texts[:40]
    expected = brute_terms(texts)
    rows = sanitise.digests(documents(list(enumerate(texts)))).collect()
    kinds = set()
    for row in rows:
        found = {x for x in row["spans"].split(",") if x.startswith(("term", "reveal"))}
        assert found == expected.get(texts[row["doc_id"]], set()), texts[row["doc_id"]]
        kinds |= {x.split(":")[0] for x in found}
    assert kinds == {"term", "reveal"}


def test_a_name_above_its_address_goes_everywhere(spark, documents):
    signed = [(k, f"Kim Zanzibar wrote note {w}\n\nmore\nKim Zanzibar\nkim@corp.example")
              for k, w in enumerate(["alpha", "bravo", "delta"])]
    docs = documents(signed + OTHERS)
    before = set(os.listdir(runs(spark)))
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(docs).collect()}
    for k, text in signed:
        assert "Zanzibar" not in clean[k] and "Kim" not in clean[k] and "note" in clean[k]
    # What is left on disk has places and labels, no personal data.
    left = [os.path.join(runs(spark), x) for x in set(os.listdir(runs(spark))) - before]
    assert left and all(
        set(spark.read.parquet(f"{x}/*").columns) == {"a", "b", "cuts"} for x in left)


def runs(spark):
    folder = os.path.join(working_folder(spark), "parleyframe")
    os.makedirs(folder, exist_ok=True)
    return folder
