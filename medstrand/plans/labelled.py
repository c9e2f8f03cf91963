"""Labels placed inside sequences, for all splits in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medstrand.operators import labels as lab
from medstrand.operators import timeline

SMALL = "small_val"


def label_sequences(
    events: DataFrame,
    demographics: DataFrame,
    labels: DataFrame,
    splits: DataFrame,
    seed: str | int,
    threshold: int = lab.LABEL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(sequences, metadata)``; sequences carry ``split`` in train, val, test and small_val.

    ``events`` is ``person_id, date, general_event_token``. ``small_val`` repeats val with frequent
    labels thinned per person. ``metadata`` counts labels by split and value.
    """
    cast = lab.cast_labels(labels)
    marks = lab.label_events(cast)
    member = splits.select(
        F.col("omop_person_id").cast(dict(events.dtypes)["person_id"]).alias("person_id"), "split"
    ).distinct()

    # The validation split appears twice; its events are copied in the scan, not read again.
    plain = events.select("person_id", "date", "general_event_token").join(member, "person_id")
    marked = marks.select(
        F.col("person_id").cast(dict(events.dtypes)["person_id"]).alias("person_id"), "date", "general_event_token"
    ).join(member, "person_id")
    small = lab.capped_sample(
        marked.filter(F.col("split") == "val"), seed, ["person_id", "date", "general_event_token"], threshold
    ).withColumn("split", F.lit(SMALL))
    both = F.when(F.col("split") == "val", F.array(F.lit("val"), F.lit(SMALL))).otherwise(F.array("split"))
    rows = (
        plain.withColumn("split", F.explode(both))
        .unionByName(marked)
        .unionByName(small)
    )
    patients = demographics.join(member, "person_id").withColumn("split", F.explode(both))
    sequences = timeline.build_sequences(rows, patients, by=["person_id", "split"])
    return sequences, lab.label_metadata(cast, splits)
