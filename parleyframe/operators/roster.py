"""Names a speaker may have."""

from pyspark.sql import functions as F

from parleyframe.functions.text import show_title, strip

# Names that are always candidates.
STAND_INS = ("Unknown Host", "Unknown Guest")


def people_from_entities(entities, label="PERSON"):
    """Sorted unique stripped texts of the entities with one label."""
    chosen = F.filter(entities, lambda e: e["label"] == label)
    return F.array_sort(F.array_distinct(F.transform(chosen, lambda e: strip(e["text"]))))


def candidate_roster(name, people, hosts=()):
    """Sorted unique candidates: people found, the show's title, the stand-ins
    and the user's hosts.  An empty title is left out before stripping."""
    title = show_title(name)
    own = F.when(title == "", F.array().cast("array<string>")).otherwise(F.array(strip(title)))
    fixed = F.array(*[F.lit(n) for n in (*STAND_INS, *hosts)])
    return F.array_sort(F.array_distinct(F.concat(
        F.coalesce(people, F.array().cast("array<string>")), own, fixed)))
