"""From profiles to the prompts of a naming model."""

from pyspark.sql import functions as F

from parleyframe.functions.prompts import ANSWER_FORMAT, naming_prompt, profile_block


def refine_targets(profiles, targets, strict=False):
    """Profiles of the target speakers (episode_id, speaker_id, target_pos).

    A target no profile has (a model can invent one) fails the job when
    ``strict`` and is left out otherwise; ``unknown_targets`` lists them.
    """
    if not strict:
        return profiles.join(targets, ["episode_id", "speaker_id"])
    joined = targets.join(
        profiles.withColumn("_known", F.lit(True)), ["episode_id", "speaker_id"], "left")
    complaint = F.concat(F.lit("no profile for speaker "), F.col("speaker_id"))
    return joined.where(
        F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    ).drop("_known")


def unknown_targets(profiles, targets):
    return targets.join(
        profiles.select("episode_id", "speaker_id"), ["episode_id", "speaker_id"], "left_anti")


def answered(profiles, proposals):
    """Every (episode_id, speaker_id) with ``asked``, whether a profile has it, and
    ``proposed``, whether a proposal names it.

    Speakers not asked about are the model's invention; those not proposed were
    left out of its answer.
    """
    def seen(table, name):
        return table.select("episode_id", "speaker_id").distinct().withColumn(name, F.lit(True))
    known = seen(profiles, "asked").join(
        seen(proposals, "proposed"), ["episode_id", "speaker_id"], "full")
    return known.fillna(False, ["asked", "proposed"])


def prompt_blocks(profiles):
    return profiles.withColumn("block", profile_block(
        F.col("speaker_id"), F.col("total_duration"), F.col("total_turns"),
        F.col("first_start"), F.col("last_end"), F.col("sample_quotes")))


def build_prompts(profiles, contexts, order=("first_start", "first_pos"),
                  instructions=ANSWER_FORMAT):
    """(episode_id, prompt) for profiles and contexts.

    ``contexts`` has (episode_id, candidate_names, context).  An episode is one
    prompt with its speakers in ``order``, which the model reads as one text.
    """
    evidence = prompt_blocks(profiles).groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, "speaker_id", "block"))).alias("b"))
    names = F.coalesce("candidate_names", F.array().cast("array<string>"))
    return (
        evidence.join(contexts, "episode_id", "left")
        .select("episode_id", naming_prompt(
            F.col("b.block"), names, F.coalesce("context", F.lit("")), instructions)
            .alias("prompt")))
