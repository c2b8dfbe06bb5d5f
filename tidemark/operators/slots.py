"""Events that name several texts in numbered slots: the texts come back in slot order, and what is not found is counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def slot_links(events: DataFrame, event: str, slots: list[str]) -> DataFrame:
    """One row for each slot that names a text: the event, the slot's place from 0 and the text's id."""
    named = F.posexplode(F.array(*(F.col(c).cast("long") for c in slots)))
    return events.select(event, named.alias("slot", "text_id")).where("text_id is not null")


def linked_texts(events: DataFrame, event: str, slots: list[str], texts: DataFrame, text_key: str, joined: dict[str, tuple[str, str]], watch: Observation | None = None) -> DataFrame:
    """The events with ``n_named``, ``n_found`` and, for each entry of ``joined`` (name: column of the texts, separator), the values of the found texts joined in slot order.

    A text id that is not there, or null, is skipped; of several texts of one id the greatest row counts. Values are trimmed; one that is null counts as empty, and if nothing but blanks is left the joined value is null. ``watch`` observes
    ``named`` and ``missing`` over all events in the same pass. Events without any slot stay; only texts that a slot names travel.
    """
    links = slot_links(events, event, slots)
    columns = list(dict.fromkeys(c for c, _ in joined.values()))
    own = texts.select(F.col(text_key).cast("long").alias("text_id"), *columns).where("text_id is not null")
    wanted = own.join(links.select("text_id").distinct(), "text_id", "left_semi")
    one = wanted.groupBy("text_id").agg(F.max(F.struct(*columns)).alias("_t"))
    met = links.join(one, "text_id", "left")
    if watch is not None:
        met = met.observe(watch, F.count(F.lit(1)).alias("named"), F.count_if(F.col("_t").isNull()).alias("missing"))
    found = F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("slot", "_t"))))
    gathered = met.groupBy(event).agg(F.count(F.lit(1)).alias("n_named"), found.alias("_found"))

    def value(column: str, separator: str):
        parts = F.transform("_found", lambda x: F.btrim(F.coalesce(x["_t"][column].cast("string"), F.lit("")), F.lit(BLANKS)))
        whole = F.btrim(F.array_join(parts, separator), F.lit(BLANKS))
        return F.when(whole != "", whole)

    texts_of = gathered.select(event, "n_named", F.size("_found").cast("long").alias("n_found"), *(value(c, sep).alias(name) for name, (c, sep) in joined.items()))
    return events.join(texts_of, event, "left").fillna(0, ["n_named", "n_found"])


def with_reactions(reactions: DataFrame, events: DataFrame, key: str, watch: Observation | None = None) -> DataFrame:
    """Reactions with the event that they name; those whose event is unknown are left out and observed as ``unknown`` of ``reactions``."""
    met = reactions.join(events.withColumn("_known", F.lit(True)), key, "left")
    if watch is not None:
        met = met.observe(watch, F.count(F.lit(1)).alias("reactions"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return met.where("_known").drop("_known")
