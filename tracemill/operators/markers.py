"""Marker densities of traces, whole and by halves, and places of markers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.config import MARKERS, PARAMS
from tracemill.functions import text as X

REGIONS = {"all": (0.0, 1.0), "early": (0.0, 0.5), "late": (0.5, 1.0)}


def marker_densities(traces: DataFrame, keys: list[str], lexicon: dict[str, list[str]] = MARKERS, regions: dict[str, tuple[float, float]] = REGIONS) -> DataFrame:
    """Long form: keys, is_error, region, category (and TOTAL for the whole text), count, density per 1000 characters.

    Traces of at most 50 characters are left out. Halves are cut by characters, so a phrase across the cut counts in
    neither, and both are measured against half the length. No shuffle: counts are made where the text is read.
    """
    rows = traces.filter(F.length("thinking_text") > PARAMS.min_chars)
    n = F.length("thinking_text")
    cells, total_n, total_d = [], F.lit(0).cast("long"), F.lit(0.0)
    for region, (a, b) in regions.items():
        part, length = (F.col("thinking_text"), n) if region == "all" else (X.region(F.col("thinking_text"), a, b), F.greatest(F.floor(n / 2), F.lit(1)))
        rows = rows.withColumn(f"_{region}", X.marker_counts(part, lexicon))
        for i, category in enumerate(lexicon):
            count = F.get(f"_{region}", F.lit(i))
            d = X.density(count, length)
            cells.append(F.struct(F.lit(region).alias("region"), F.lit(category).alias("category"), count.alias("count"), d.alias("density")))
            if region == "all":
                total_n, total_d = total_n + count, total_d + d
    if "all" in regions:
        cells.append(F.struct(F.lit("all").alias("region"), F.lit("TOTAL").alias("category"), total_n.alias("count"), total_d.alias("density")))
    error = (~F.col("is_correct")).cast("int").alias("is_error")
    return rows.select(*keys, error, F.explode(F.array(*cells)).alias("cell")).select(*keys, "is_error", "cell.*")


def early_or_late(correlations: DataFrame) -> DataFrame:
    """Which half's density goes with error more."""
    side = lambda region: F.max(F.when(F.col("region") == region, F.col("rho")))
    out = correlations.filter("region <> 'all'").groupBy("model_name", "category").agg(side("early").alias("early_rho"), side("late").alias("late_rho"))
    return out.withColumn("stronger", F.when(F.abs("early_rho") > F.abs("late_rho"), "EARLY").otherwise("LATE"))


def step_density(sentences: DataFrame, keys: list[str], lexicon: dict[str, list[str]] = MARKERS) -> DataFrame:
    """Markers per word of each sentence."""
    total = F.aggregate(X.marker_counts(F.col("sentence"), lexicon), F.lit(0).cast("long"), lambda a, x: a + x)
    return sentences.select(*keys, "pos", total.alias("markers"), X.word_count(F.col("sentence")).cast("long").alias("words")).withColumn("density", F.try_divide("markers", "words"))


def density_at(densities: DataFrame, places: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Each trace of ``places`` with the density (R3) of the sentence at its ``place``; traces without one (-1) drop out.

    Keys are those of a trace, so both sides are dealt alike and the lookup is an equi-join on trace and place.
    """
    at = places.filter(F.col(place) >= 0).withColumn("pos", F.col(place))
    return densities.withColumn("pos", F.col("pos").cast("long")).join(at, [*keys, "pos"]).drop("pos", "markers", "words")


def marker_positions(sentences: DataFrame, keys: list[str], lexicon: dict[str, list[str]] = MARKERS) -> DataFrame:
    """(keys, pos, category) of every category that occurs in a sentence, however often; ``keys`` may name more columns to carry."""
    hit = lambda ps: reduce(or_, [F.coalesce(F.col("sentence").rlike(f"(?iu){p}"), F.lit(False)) for p in ps])
    of_words = lambda f, words: F.array(*[F.when(F.arrays_overlap(f, F.array(*map(F.lit, ws))), F.lit(c)) for c, ws in words.items()])
    of_patterns = lambda: F.array(*[F.when(hit(ps), F.lit(c)) for c, ps in lexicon.items()])
    found = F.array_compact(X.with_words(F.coalesce("sentence", F.lit("")), lexicon, of_words, of_patterns))
    return sentences.select(*keys, "pos", F.explode_outer(found).alias("category")).filter("category is not null")
