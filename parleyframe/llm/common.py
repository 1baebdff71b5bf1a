"""What the operators of this folder share."""

import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Blank and tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def id_and_text(docs, id_column="doc_id", text_column="text", empty_for_null=True):
    """``doc_id`` and ``text`` alone, so that no other column can clash."""
    text = docs[text_column]
    return docs.select(
        docs[id_column].alias("doc_id"),
        (F.coalesce(text, F.lit("")) if empty_for_null else text).alias("text"))


def text_key(text):
    """128 bits that tell apart rows that repeat an id with another text."""
    return F.struct(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def map_batches(frame, function, schema):
    """``function(record batch) -> arrow table`` over the partitions of a frame."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch).to_batches()
    return frame.mapInArrow(run, schema)


def shuffled(side):
    """A side of a join that shuffles both.

    Spark sizes the rows that an explode makes as if there were one for each row that
    goes in, so without the hint it may collect and broadcast any number of them.
    """
    return side.hint("merge")


def packed(docs):
    """All columns as one struct ``row``, to pass through Python together."""
    return docs.select(F.struct("*").alias("row"))


def column_of(batch, name):
    """A column of the rows packed in a batch."""
    return pc.struct_field(batch["row"], name)


def with_fields(field, ddl):
    """A schema of one field of another schema and the columns of a DDL string."""
    return StructType([field, *StructType.fromDDL(ddl)])
