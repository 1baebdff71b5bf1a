"""Speaker identities from voice embeddings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_speakers(turns, label="local_label"):
    """Distinct labels per episode."""
    return turns.groupBy("episode_id").agg(F.countDistinct(label).alias("n_speakers"))


def target_speakers(counts, num_speakers=None):
    """The wanted number if one is given (and not 0), otherwise the count."""
    return counts.withColumn(
        "num_speakers",
        F.coalesce(F.nullif(F.lit(num_speakers).cast("int"), F.lit(0)),
                   F.col("n_speakers").cast("int")))


def centroids(labelled):
    """(episode_id, label, centroid): element-wise mean embedding per label.

    Averages are combined before the shuffle, so a label contributes one row
    per vector element and input partition, however many turns it has.
    """
    return (
        labelled.select("episode_id", "label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("episode_id", "label", "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("episode_id", "label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("e"))
        .select("episode_id", "label", F.col("e.mean").alias("centroid")))


def _units(matrix):
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(vectors):
    """A column of equally long vectors as one array."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(
        len(vectors), -1).astype("float64")


def _nearest(turns):
    """Cosine-nearest centroid of each turn; the lowest label wins ties."""
    n = turns.num_rows
    labels, gaps = np.full(n, -1, "int32"), np.full(n, np.nan)
    episodes = turns["episode_id"].combine_chunks().dictionary_encode()
    codes = episodes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for code in np.unique(codes):
        mine = np.flatnonzero(codes == code)
        middles = turns["middles"][int(mine[0])].as_py()
        if middles:
            vectors = _matrix(turns["embedding"].take(pa.array(mine)))
            middle = np.array([m["centroid"] for m in middles], dtype="float64")
            distance = np.clip(1.0 - _units(vectors) @ _units(middle).T, 0.0, 2.0)
            best = distance.argmin(axis=1)
            labels[mine] = np.array([m["label"] for m in middles], "int32")[best]
            gaps[mine] = distance[np.arange(len(best)), best]
    missing = np.isnan(gaps)
    return turns.drop_columns(["embedding", "middles"]).append_column(
        "label", pa.array(labels, mask=missing)).append_column(
        "distance", pa.array(gaps, mask=missing))


def assign_centroid(turns, middles):
    """Give every turn the label of its episode's nearest centroid.

    ``turns`` has (episode_id, chunk_idx, turn_pos, embedding, ...) and
    ``middles`` (episode_id, label, centroid).  The few centroids of an episode
    are one row, joined by episode: adaptive execution copies them to the tasks
    if they are small and otherwise splits an episode that holds many turns.
    Vectors are multiplied as Arrow batches where they stand.  An episode
    without centroids gets NULL.
    """
    per_episode = middles.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("middles"))
    schema = T.StructType(
        [f for f in turns.schema if f.name != "embedding"]
        + [T.StructField("label", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield from _nearest(pa.Table.from_batches([batch])).to_batches()

    joined = turns.join(per_episode, "episode_id", "left")
    return joined.select(*turns.columns, "middles").mapInArrow(run, schema)


def average_linkage(vectors, weights, k):
    """Cut the average-linkage tree over cosine distance into ``k`` clusters.

    The mean cosine distance between two clusters is one minus the dot product
    of their mean unit vectors, so only sums of unit vectors are kept and no
    distance matrix is built.  Clusters are merged along chains of nearest
    neighbours, then the lowest ``n - k`` merges are applied.
    """
    n = len(vectors)
    weights = np.asarray(weights, dtype="float64")
    sums = _units(np.asarray(vectors, dtype="float64")) * weights[:, None]
    sizes = weights.copy()
    alive = np.ones(n, dtype=bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(alive.argmax()))
        top = chain[-1]
        gaps = 1.0 - (sums @ sums[top]) / (sizes * sizes[top])
        gaps[~alive] = np.inf
        gaps[top] = np.inf
        near = int(gaps.argmin())
        if len(chain) > 1 and gaps[chain[-2]] <= gaps[near]:
            near = chain[-2]
            del chain[-2:]
            merges.append((gaps[near], top, near))
            sums[near] += sums[top]
            sizes[near] += sizes[top]
            alive[top] = False
        else:
            chain.append(near)
    merges.sort(key=lambda merge: merge[0])
    owner = list(range(n))

    def root(i):
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for _, a, b in merges[:max(0, n - k)]:
        owner[root(a)] = root(b)
    numbers = {}
    return [numbers.setdefault(root(i), len(numbers)) for i in range(n)]


def _cluster(group):
    group = group.sort_by("first_pos")
    labels = average_linkage(
        _matrix(group["embedding"]), group["copies"].to_numpy(), group["num_speakers"][0].as_py())
    return group.select(["episode_id", "embedding"]).append_column(
        "label", pa.array(labels, pa.int32()))


def cluster_speakers(reference, targets):
    """Label the turns of each episode's reference chunk by average linkage.

    ``reference`` has (episode_id, turn_pos, embedding), ``targets``
    (episode_id, num_speakers).  Clusters are numbered by first turn.  Equal
    embeddings are clustered as one weighted point, so copies cost nothing.  A
    group is one window of audio, whose length bounds its turns; memory grows
    with the turns, not with their pairs.
    """
    points = reference.groupBy("episode_id", "embedding").agg(
        F.count("*").alias("copies"), F.min("turn_pos").alias("first_pos"))
    labels = points.join(
        targets.select("episode_id", "num_speakers"), "episode_id"
    ).groupBy("episode_id").applyInArrow(
        _cluster, "episode_id string, embedding array<float>, label int")
    return reference.join(labels, ["episode_id", "embedding"])
