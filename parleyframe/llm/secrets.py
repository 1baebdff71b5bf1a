"""Secret scans with linking of multipart credentials.

Strong parts are found by pattern alone and always reported: ``assign`` and
``hex`` (secrets) and ``access`` (identifiers).  Weak parts, ``identifier``,
``opaque`` (secrets) and ``endpoint``, are reported only when a complementary
part stands within ``reach`` code points in the same text: a secret needs an
identifier or an endpoint, an identifier or an endpoint needs a secret.  A weak
part over a strong one of its own role is that part read again and not reported
beside it; it is a partner as any other.  Two parts that overlap are readings of
one string and no pair, and an opaque string that is itself an identifier or an
access id is no secret.  An opaque string is 20 or more characters of which at
least half stand in pieces that are not words: words, names in camel case, words
in capitals, and each of these with digits at its end are ordinary (so letters
alone, without digits or mixed case, are no secret), while a hexadecimal string
with digits and letters always counts.  In the host or path of an endpoint there
is no opaque string; what stands in its query, and a strong secret anywhere in it,
is ``carried`` by it and a partner of identifiers alone, so that two links are no
credential.  The parts meet in
an interval join on (text, cell of ``reach`` code points); parts of one kind do
not overlap, so the partners of a part are bounded by the reach.

Null and empty texts have no parts.  Rows that repeat an id and a text are
answered alike, one answer per row; an id may be null.
"""

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, map_batches, text_key
from parleyframe.sources.tables import settle

#: Order of kinds that start at one place.
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENTIFIER = re.compile(
    r"""(?:access|client|account|user|app)_?(?:key_?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""",
    re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"""(?<![A-Za-z])[A-Za-z][A-Za-z0-9+.-]{1,11}://[^\s"'<>]{3,}""")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_SOLID = re.compile("[A-Za-z0-9]+")
_HEX_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{20,}|[0-9A-F]{20,})")
# Words in camel case, with one acronym before a word and one at the end; possessive,
# so that a long string is read once.
_WORDS = "(?:[A-Z]?+[a-z]{2,}+|[A-Z][a-z])*+"
_ORDINARY = re.compile(
    f"(?:{_WORDS}(?:[A-Z]{{2,5}}+[a-z]{{2,}}+)?+{_WORDS}[A-Z]{{0,4}}|[A-Z]+|[A-Za-z])[0-9]*")

PART = "array<struct<kind:string,role:string,begin:int,end:int>>"


def strong_parts(text):
    """(start, kind, end) of the parts that stand on their own."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def endpoints(text):
    """(start, end of host and path, end) of every endpoint."""
    if "://" not in text:
        return []
    return [(m.start(), m.start() + len(re.split("[?#]", m[0], maxsplit=1)[0]), m.end())
            for m in _ENDPOINT.finditer(text)]


def around(places, begin, end):
    """The last of the endpoints that ``begin`` to ``end`` overlaps, or None."""
    at = bisect_left(places, (end,)) - 1
    return places[at] if at >= 0 and places[at][2] > begin else None


def weak_parts(text, places=None):
    """(start, kind, end) of what is a secret only in company."""
    places = endpoints(text) if places is None else places
    found = [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    ids = sorted(found + [x for x in strong_parts(text) if x[1] == 1])
    for begin, end in _apart(_opaque(text), ids):
        place = around(places, begin, end)
        if place is None or begin >= place[1]:
            found.append((begin, 4, end))
    return sorted(found + [(begin, 5, end) for begin, _, end in places])


def is_opaque(value):
    """Whether a string is hexadecimal or at least half of it in no word."""
    if _HEX_KEY.fullmatch(value):
        return True
    pieces = _SOLID.findall(value)
    strange = sum(len(x) for x in pieces if not _ORDINARY.fullmatch(x))
    return 0 < sum(map(len, pieces)) <= 2 * strange


def _opaque(text):
    return [m.span() for m in _OPAQUE.finditer(text) if is_opaque(m[0])]


def _apart(spans, ids):
    """The spans that do not end in one of the sorted ``ids`` that they overlap."""
    ends = list(accumulate((x[2] for x in ids), max))
    for begin, end in spans:
        at = bisect_left(ids, (end,)) - 1
        if at < 0 or ends[at] < end:
            yield begin, end


_ROLE = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}


def read_again(weak, strong):
    """Whether each of the sorted weak parts overlaps a strong part of its role."""
    by_role = {}
    for begin, kind, end in strong:
        by_role.setdefault(_ROLE[kind], []).append((begin, end))
    latest = {role: list(accumulate((end for _, end in own), max)) for role, own in by_role.items()}
    out = []
    for begin, kind, end in weak:
        own = by_role.get(_ROLE[kind], [])
        at = bisect_left(own, (end,)) - 1
        out.append(at >= 0 and latest[_ROLE[kind]][at] > begin)
    return out


def _parts(docs, id_column, text_column):
    def find(batch):
        strong, weak, again = [], [], []
        for value in batch["text"]:
            text = value.as_py()
            own, places = strong_parts(text), endpoints(text)
            strong.append(_rows(own, places))
            others = weak_parts(text, places)
            seen = read_again(others, own)
            weak.append(_rows([x for x, same in zip(others, seen) if not same], places))
            again.append(_rows([x for x, same in zip(others, seen) if same], places))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("role", pa.string()),
                                   ("begin", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": batch["doc_id"], "key": batch["key"],
                         "strong": pa.array(strong, kind), "weak": pa.array(weak, kind),
                         "again": pa.array(again, kind)})

    texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
    kinds = dict(texts.dtypes)
    return map_batches(
        texts, find, f"doc_id {kinds['doc_id']}, key {kinds['key']}, strong {PART}, weak {PART}, "
        f"again {PART}")


def _rows(parts, places):
    def role(begin, kind, end):
        inside = _ROLE[kind] == "secret" and around(places, begin, end)
        return "carried" if inside else _ROLE[kind]
    return [{"kind": KINDS[k], "role": role(a, k, b), "begin": a, "end": b} for a, k, b in parts]


def _cells(begin, end, reach):
    return F.sequence(F.floor(begin / reach), F.floor(end / reach))


def linked_parts(parts, reach=300):
    """Weak parts with a complementary part within reach, and that partner.

    ``parts``: distinct rows key, kind, role, weak, begin, end.  A pair is met
    in each cell that both touch and kept in the first of them; the parts of a
    pair do not overlap.
    """
    left = parts.where("weak").withColumn(
        "cell", F.explode(_cells(F.col("begin") - reach, F.col("end") + reach, reach)))
    right = parts.select(
        F.col("key").alias("other_key"), F.col("role").alias("other_role"),
        F.col("kind").alias("other_kind"), F.col("begin").alias("other_begin"),
        F.col("end").alias("other_end"),
        F.explode(_cells(F.col("begin"), F.col("end"), reach)).alias("other_cell"))
    secrets = ("secret", "carried")
    roles = F.array("role", "other_role")
    complementary = (
        (F.col("role").isin(*secrets) != F.col("other_role").isin(*secrets))
        & ~(F.array_contains(roles, "carried") & F.array_contains(roles, "endpoint")))
    apart = (F.col("other_end") <= F.col("begin")) | (F.col("end") <= F.col("other_begin"))
    first = F.greatest(
        F.floor((F.col("begin") - reach) / reach), F.floor(F.col("other_begin") / reach))
    return left.join(
        right, (F.col("key") == F.col("other_key")) & (F.col("cell") == F.col("other_cell"))
        & complementary & apart & (F.col("cell") == first)
        & (F.col("other_begin") <= F.col("end") + reach)
        & (F.col("begin") - reach <= F.col("other_end"))).select(
        "key", "kind", "begin", "end", "other_kind", "other_begin", "other_end")


def scan(docs, id_column="doc_id", text_column="text", reach=300):
    """doc_id, strong and linked (arrays of kind, begin, end in code points)."""
    found = settle(_parts(docs, id_column, text_column), "secret-parts")
    parts = found.where(F.size("weak") > 0).select(
        "key", F.explode(F.concat(
            F.transform(F.concat("strong", "again"), lambda x: F.struct(
                F.lit(False).alias("weak"), x.alias("x"))),
            F.transform("weak", lambda x: F.struct(F.lit(True).alias("weak"), x.alias("x")))))
        .alias("p")).select("key", "p.weak", "p.x.*").distinct()
    linked = settle(linked_parts(parts, reach).groupBy("key").agg(
        F.collect_set(F.struct("kind", "begin", "end")).alias("linked")), "linked-parts")
    return found.join(linked, "key", "left").select(
        "doc_id", F.transform("strong", lambda x: F.struct(
            x["kind"].alias("kind"), x["begin"].alias("begin"), x["end"].alias("end")))
        .alias("strong"),
        F.coalesce("linked", F.array().cast("array<struct<kind:string,begin:int,end:int>>"))
        .alias("linked"))


def _listed(spans):
    """kind:start:end by start, then by the order of the kinds."""
    order = F.array(*map(F.lit, KINDS))
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["begin"].alias("begin"), F.array_position(order, x["kind"]).alias("place"),
        x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(
        placed, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")


def digests(docs, **options):
    """Counts of the strong parts, their digest and all spans, per row."""
    def count(kind):
        return F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long")
    return scan(docs, **options).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"),
        _listed(F.concat("strong", "linked")).alias("spans"))
