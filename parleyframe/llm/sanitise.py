"""Personal data and the terms that give it away, with DataFrame functions only.

Values of four kinds are found by pattern and check.  What else betrays them is
measured on the corpus: for a protected value c and a word t, the part of c's
information that t discloses is PMI(c; t) / IC(c), with probabilities counted
over the distinct texts; c and t stand together in a text where t is in a line
of c or one beside it.  Words that stand together with c in ``support`` or more
texts and disclose ``generalise`` or more of it are spans too, wherever they are
in a text that holds c: ``term`` (replaced by a placeholder), or ``reveal`` from
``remove`` on (taken out).  A word is two letters or digits or more, one of them
a letter.

Null and empty texts hold nothing.  No pattern crosses a line feed, so lines are
searched apart.  Equal texts are searched once, by a 128-bit key; rows that
repeat an id or a text are answered one by one.  Tables with lines and values
are removed when the spans are known.
"""

from contextlib import contextmanager

from pyspark.sql import Window
from pyspark.sql import functions as F

from parleyframe.llm.common import id_and_text, shuffled, text_key
from parleyframe.sources.tables import drop_folder, run_folder, settle

#: Order of kinds that start at one place.
KINDS = ("email", "ip", "card", "phone", "term", "reveal")

# Possessive and anchored forms of the contract's patterns: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a line with a valid match of any kind holds at least.
_ANY = r"@|\+[0-9]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?[0-9]){13}"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_WORD = r"(?<![\p{L}\p{N}])(?=\p{N}*+\p{L})[\p{L}\p{N}]{2,}+"
#: Up to so many terms are joined as a copy in every task; more by a shuffle.
COPIED_TERMS = 20_000
#: Common words are ruled out by this part of the texts, dealt by hash.
BOUNDED_BY = 16

LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]",
          "term": "[TERM]", "reveal": ""}


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    """Whether the check digit of up to 19 digits is right."""
    backwards = F.reverse(digits)
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(values, F.lit(0), lambda n, x: n + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind, value):
    digits = _digits(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _found(text, pattern):
    """Array of (gap, match): the length before each match since the last, and the match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), F.length)
    return F.when(text.rlike(pattern), F.arrays_zip(
        F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match")))


def _placed(rows, by):
    """Rows with gap and match, in order of ``at`` within ``by``, get begin and end."""
    length = F.length("match")
    end = F.sum(F.col("gap") + length).over(Window.partitionBy(*by).orderBy("at"))
    return rows.withColumn("end", end.cast("int")).withColumn(
        "begin", (F.col("end") - length).cast("int"))


def suspect_lines(texts):
    """a, b, line, text, start: the lines, with their places, of every distinct
    text that may hold personal data."""
    lines = texts.where(F.col("text").rlike(_ANY)).select(
        "key.a", "key.b", F.posexplode(F.split("text", "\n")).alias("line", "text")).distinct()
    before = F.sum(F.length("text") + 1).over(
        Window.partitionBy("a", "b").orderBy("line")) - F.length("text") - 1
    return lines.withColumn("start", before.cast("int"))


def values_in(lines):
    """a, b, line, kind, begin, end (in the text) and value of all valid matches."""
    kinds = F.array(*(
        F.struct(F.lit(kind).alias("kind"), _found(F.col("text"), pattern).alias("found"))
        for kind, pattern in PATTERNS.items()))
    rows = lines.where(F.col("text").rlike(_ANY)).select(
        "a", "b", "line", "start", F.explode(kinds).alias("k")).where(
        F.size("k.found") > 0).select(
        "a", "b", "line", "start", "k.kind", F.posexplode("k.found").alias("at", "f")).select(
        "a", "b", "line", "start", "kind", "at", "f.gap", "f.match")
    checked = F.lit(False)
    for kind in PATTERNS:
        checked = F.when(F.col("kind") == kind, _valid(kind, F.col("match"))).otherwise(checked)
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(
        F.lower("match"))
    return _placed(rows, ("a", "b", "line", "kind")).where(checked).select(
        "a", "b", "line", "kind", (F.col("start") + F.col("begin")).alias("begin"),
        (F.col("start") + F.col("end")).alias("end"), value.alias("value"))


# An address is read as one match, so that its parts are not words.
_WORD_OR_ADDRESS = PATTERNS["email"] + "|" + _WORD


def _words(text):
    low = F.lower(text)
    return F.array_distinct(F.when(F.contains(text, F.lit("@")), F.filter(
        F.regexp_extract_all(low, F.lit(_WORD_OR_ADDRESS), F.lit(0)),
        lambda w: ~F.contains(w, F.lit("@")))).otherwise(
        F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))))


def disclosing_terms(texts, lines, values, folder=None, support=3, generalise=0.8):
    """kind, value, term, share (of the value's information, 0 to 1): the words
    that give a protected value away."""
    held = values.select("a", "b", "line", "kind", "value").distinct()
    of_value = settle(
        held.groupBy("kind", "value").agg(F.count_distinct("a", "b").alias("n_value"))
        .where(F.col("n_value") >= support), "often", folder)
    beside = held.join(of_value, ["kind", "value"]).withColumn(
        "line", F.explode(F.array(*(F.col("line") + k for k in (-1, 0, 1))))).distinct()
    together = settle(
        beside.join(lines.select("a", "b", "line", "text"), ["a", "b", "line"]).select(
            "kind", "value", "n_value", "a", "b", F.explode(_words(F.col("text"))).alias("term"))
        .distinct().groupBy("kind", "value", "n_value", "term").agg(F.count("*").alias("n_both"))
        .where(F.col("n_both") >= support), "terms-beside-values", folder)
    total = texts.agg(F.count_distinct("key.a")).first()[0]
    # In more texts than this a word discloses too little about any of its values.
    most = F.col("n_both") * F.pow(total / F.col("n_value"), F.lit(1 - generalise))
    terms = settle(together.where(F.col("n_value") < total).groupBy("term").agg(
        F.max(most).alias("most")), "terms", folder)
    # Common words are known by a part of the texts, a lower bound; the others
    # are counted over all of them.
    part = _texts_with(texts.where(F.pmod("key.a", F.lit(BOUNDED_BY)) == 0), terms)
    rare = settle(terms.join(part, "term", "left").where(
        F.coalesce("n_term", F.lit(0)) <= F.col("most") * 1.001).select("term"),
        "rare-terms", folder)
    # Settled, so that a word beside many values is split in the join.
    of_term = settle(_texts_with(texts, rare), "texts-of-terms", folder)
    share = (F.log(F.col("n_both") * total) - F.log(F.col("n_value") * F.col("n_term"))) / F.log(
        total / F.col("n_value"))
    return together.join(of_term, "term").where(F.col("n_value") < total).select(
        "kind", "value", "term", share.alias("share")).where(F.col("share") >= generalise)


def _texts_with(texts, terms):
    """term, n_term: the number of distinct texts that hold each of the terms."""
    wanted = terms.select("term")
    few = wanted.count()
    if not few:
        return wanted.withColumn("n_term", F.lit(0).cast("bigint"))
    return texts.select(
        F.col("key.a").alias("context"), F.explode(_words(F.col("text"))).alias("term")).join(
        F.broadcast(wanted) if few <= COPIED_TERMS else wanted, "term", "left_semi").distinct().groupBy(
        "term").agg(F.count("*").alias("n_term"))


def term_spans(lines, values, disclosing, remove=0.95):
    """a, b, line, kind, begin, end, term of disclosing words in the texts of their values."""
    wanted = values.select("a", "b", "kind", "value").distinct().join(
        disclosing, ["kind", "value"]).groupBy("a", "b", "term").agg(
        F.max("share").alias("share"))
    there = lines.join(wanted.select("a", "b").distinct(), ["a", "b"], "left_semi")
    words = _placed(there.select(
        "a", "b", "line", "start", F.posexplode(_found(F.col("text"), _WORD_OR_ADDRESS)).alias("at", "f")
    ).select("a", "b", "line", "start", "at", "f.gap", "f.match"), ("a", "b", "line"))
    return words.withColumn("term", F.lower("match")).join(
        shuffled(wanted), ["a", "b", "term"]).select(
        "a", "b", "line", F.when(F.col("share") >= remove, "reveal").otherwise("term").alias("kind"),
        (F.col("start") + F.col("begin")).alias("begin"),
        (F.col("start") + F.col("end")).alias("end"), "term")


@contextmanager
def _searched(docs, id_column, text_column, support, generalise, remove):
    """Texts with their keys, and the spans of values and of terms, for the time of a
    ``with`` block: what holds personal data is deleted at its end."""
    spark = docs.sparkSession
    folder = run_folder(spark)
    try:
        texts = id_and_text(docs, id_column, text_column).withColumn("key", text_key(F.col("text")))
        lines = settle(suspect_lines(texts), "suspect-lines", folder)
        values = settle(values_in(lines), "personal-values", folder)
        disclosing = settle(
            disclosing_terms(texts, lines, values, folder, support, generalise), "shares", folder)
        yield texts, values, settle(term_spans(lines, values, disclosing, remove), "terms", folder)
    finally:
        drop_folder(spark, folder)


def spans(docs, id_column="doc_id", text_column="text", support=3, generalise=0.8, remove=0.95):
    """doc_id, base and terms: arrays of (begin, place in KINDS, end, kind), ascending."""
    order = F.array(*map(F.lit, KINDS))
    span = F.struct("begin", F.array_position(order, F.col("kind")).alias("place"), "end", "kind")
    is_term = F.col("kind").isin("term", "reveal")
    with _searched(docs, id_column, text_column, support, generalise, remove) as searched:
        texts, values, terms = searched
        found = settle(values.drop("value").unionByName(terms.drop("term")).groupBy("a", "b").agg(
            F.array_sort(F.collect_set(F.when(~is_term, span))).alias("base"),
            F.array_sort(F.collect_set(F.when(is_term, span))).alias("terms")), "spans")
    none = F.array().cast("array<struct<begin:int,place:bigint,end:int,kind:string>>")
    return texts.select("doc_id", "key.a", "key.b").join(found, ["a", "b"], "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))


def _listed(found):
    return F.array_join(F.transform(
        found, lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])), ",")


def digests(docs, **options):
    """Counts of the kinds, the digest of the base spans and all spans, per row."""
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans(docs, **options).select(
        "doc_id", *map(count, PATTERNS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def cuts(values, terms):
    """a, b and cuts: the spans of each text, overlapping ones merged, as ascending
    (begin, end, label).  A value's label stands before a word's, then the first."""
    every = values.drop("value").unionByName(terms.drop("term")).select(
        "a", "b", "begin", "end", "kind").distinct()
    before = Window.partitionBy("a", "b").orderBy("begin", "end", "kind")
    new = F.coalesce(F.col("begin") >= F.max("end").over(
        before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = every.withColumn("new", new.cast("int")).withColumn(
        "number", F.sum("new").over(before)).groupBy("a", "b", "number").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.min(F.struct(
            F.when(F.col("kind") == "reveal", 2).when(F.col("kind") == "term", 1).otherwise(0)
            .alias("rank"), "begin", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
            .alias("place"), "kind")).alias("first"))
    label = F.lit("")
    for kind, instead in LABELS.items():
        label = F.when(F.col("first.kind") == kind, instead).otherwise(label)
    return merged.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct(
        "begin", "end", label.alias("label")))).alias("cuts"))


def _cut(text, spans):
    """The text with ascending spans, which do not overlap, replaced by their labels."""
    def piece(x, i):
        since = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        return F.concat(text.substr(since + 1, x["begin"] - since), x["label"])

    last = F.get(spans, F.size(spans) - 1)["end"]
    return F.concat(F.array_join(F.transform(spans, piece), ""), text.substr(
        last + 1, F.length(text) - last))


def sanitise(docs, id_column="doc_id", text_column="text", support=3, generalise=0.8, remove=0.95):
    """``docs`` with values replaced by labels, disclosing words by ``[TERM]`` or nothing:
    the original texts, cut once by the spans that ``spans`` tells."""
    with _searched(docs, id_column, text_column, support, generalise, remove) as searched:
        found = settle(cuts(*searched[1:]), "cuts")
    known = F.coalesce(docs[text_column], F.lit(""))
    key, text = text_key(known), F.col("row")[text_column]
    # Only texts that are searched can have cuts; the others stay where they are.
    suspect = docs.where(known.rlike(_ANY)).select(
        F.struct("*").alias("row"), key["a"].alias("a"), key["b"].alias("b")).join(
        found, ["a", "b"], "left")
    out = suspect.withColumn("clean", F.when(
        F.col("cuts").isNull(), text).otherwise(_cut(text, F.col("cuts"))))
    return docs.where(~known.rlike(_ANY)).unionByName(out.select(*(
        F.col("clean" if name == text_column else f"row.`{name}`").alias(name)
        for name in docs.columns)))
