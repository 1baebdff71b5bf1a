"""Text a naming model is asked with."""

from pyspark.sql import functions as F

from parleyframe.functions.text import fixed, limit_words, strip

# What an answer must look like to be read; everything else is the caller's wording.
ANSWER_FORMAT = (
    "Reply with a JSON array of objects: speaker_id, proposed_name (or \"UNKNOWN\"), "
    "confidence from 0 to 1, justification.\n")
SECOND_ROUND = "\nSecond round."

# The layouts below are fixed values: labels, their order, and line breaks.


def profile_block(speaker_id, total_duration, total_turns, first_start, last_end, quotes):
    """The evidence of one speaker."""
    shown = F.transform(quotes, lambda q: F.concat(F.lit('- "'), q, F.lit('"')))
    return F.concat(
        F.lit("Speaker: "), speaker_id,
        F.lit("\ntotal_duration_sec: "), fixed(total_duration, 1),
        F.lit("\nturn_count: "), total_turns.cast("string"),
        F.lit("\nfirst_start_sec: "), fixed(first_start, 1),
        F.lit("\nlast_end_sec: "), fixed(last_end, 1),
        F.lit("\nQuotes:\n"), F.array_join(shown, "\n"), F.lit("\n"))


def context_summary(name, description, most_words):
    return F.concat(
        F.lit("Title: "), name,
        F.lit("\nDescription: "), limit_words(strip(description), most_words))


def naming_prompt(blocks, names, context, instructions=ANSWER_FORMAT):
    """Instructions, episode context, candidate names and all evidence blocks."""
    candidates = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Unknown")
    return F.concat(
        F.lit(instructions + "\nEpisode Context:\n"), context,
        F.lit("\n\nCandidate Names: "), candidates,
        F.lit("\n\nSpeaker Evidence:\n"), F.array_join(blocks, "\n\n"), F.lit("\n"))
