"""Batch ingestion: gate, hash, duplicates, extraction, chunks, embedding, commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.governance import mime_of
from attesta.functions.hooks import embed
from attesta.functions.text import chunk_array, content_hash, distinct_chunks, explode_chunks, html_to_text, is_blank, let
from attesta.operators.aggregates import ingest_report
from attesta.operators.filters import gate, live
from attesta.rules import MIN_CHUNK
from attesta.session import staged
from attesta.sources.index import ChunkIndex

BROADCAST_IDS = 2_000_000


@dataclass
class Committed:
    """State after a run that was committed."""

    sources: DataFrame
    outcomes: DataFrame
    report: DataFrame


@dataclass
class Ingested:
    """Results of one run; all lazy but the stored ``judged`` (source_id, content_hash, reason, outcome).

    ``hashes`` has the content_hash of every source_id that was ingested.
    """

    chunks: DataFrame
    outcomes: DataFrame
    report: DataFrame
    hashes: DataFrame
    judged: DataFrame


def extract_text(df: DataFrame, content: str = "content", mime: str = "mime") -> DataFrame:
    """Text of the formats Spark reads itself; other types keep a null text (use the extraction hook)."""
    text = F.when(F.col(mime) == "text/html", html_to_text(content)).when(F.col(mime) == "text/plain", F.col(content))
    return df.withColumn("extracted", let(text, lambda x: F.when(~is_blank(x), x)))


def judge(sources: DataFrame, held: DataFrame | None = None, index: ChunkIndex | None = None) -> DataFrame:
    """(source_id, content_hash, outcome, reason) of every live source.

    ``held`` (content_hash, held_by) names contents already served; from an ``index`` only the
    rows of this run's contents and sources are read. A source that serves this very content
    is skipped. In one run the smallest id that can be ingested holds a content; the others
    are skipped, and so are those whose content another source serves as the run begins.
    Only ids, hashes and lengths leave the scan of the texts, and only texts that pass the gate are extracted.
    """
    gated = gate(live(sources)).withColumn("mime", mime_of("uri"))
    facts = extract_text(gated).select(
        "source_id",
        "gate_reason",
        content_hash("content").alias("document_hash"),
        F.when(F.col("gate_reason").isNull(), F.length("extracted")).alias("n_extracted"),
    )
    facts = staged(facts)  # ids, hashes and lengths: the texts are read and hashed once
    # the first chunk is the longest one, so it decides whether any is long enough
    facts = facts.withColumn(
        "failure",
        F.when(F.col("n_extracted").isNull(), F.lit("EXTRACTION_FAILED")).when(
            F.col("n_extracted") < MIN_CHUNK, F.lit("NO_USABLE_CHUNKS")
        ),
    )
    usable = F.col("gate_reason").isNull() & F.col("failure").isNull()
    holders = facts.groupBy("document_hash").agg(F.min(F.when(usable, F.col("source_id"))).alias("held_by"))
    joined = facts.join(holders, "document_hash", "left")
    earlier = F.col("held_by") < F.col("source_id")
    unchanged = F.lit(None).cast("string")
    if index is not None:
        held = index.holders(facts.select(F.col("document_hash").alias("content_hash")))
        same = index.current(facts).select("source_id", F.col("content_hash").alias("_current"))
        joined = joined.join(same, "source_id", "left")
        unchanged = F.when(F.col("_current") == F.col("document_hash"), F.lit("UNCHANGED_CONTENT"))
    if held is not None:
        stored = held.select(F.col("content_hash").alias("document_hash"), F.col("held_by").alias("_stored"))
        joined = joined.join(stored, "document_hash", "left")
        earlier = F.when(F.col("_stored").isNotNull(), F.col("_stored") != F.col("source_id")).otherwise(earlier)
    duplicate = F.when(F.coalesce(earlier, F.lit(False)), F.lit("DUPLICATE_CONTENT"))
    reason = F.coalesce("gate_reason", unchanged, duplicate, "failure")
    return joined.select("source_id", F.col("document_hash").alias("content_hash"), reason.alias("reason")).withColumn(
        "outcome",
        F.when(F.col("reason").isNull(), F.lit("ingested"))
        .when(F.col("reason").isin("DUPLICATE_CONTENT", "UNCHANGED_CONTENT"), F.lit("skipped"))
        .otherwise(F.lit("failed")),
    )


def accepted_only(sources: DataFrame, judged: DataFrame) -> DataFrame:
    """Sources with the outcome ``ingested``.

    The counted ids of the smaller side go to the texts where they are few enough;
    only beyond that are texts shuffled by id.
    """
    taken = F.col("outcome") == "ingested"
    accepted, rejected = judged.filter(taken).select("source_id"), judged.filter(~taken).select("source_id")
    n_accepted, n_rejected = judged.agg(F.count_if(taken), F.count_if(~taken)).first()
    if n_rejected <= min(n_accepted, BROADCAST_IDS):
        return sources.join(F.broadcast(rejected), "source_id", "left_anti")
    if n_accepted <= BROADCAST_IDS:
        return sources.join(F.broadcast(accepted), "source_id", "left_semi")
    return sources.join(accepted, "source_id", "left_semi")


def outcomes_of(judged: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, outcome, reason, chunks) of every judged source, with the number of its chunk rows."""
    per_source = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
    return judged.join(per_source, "source_id", "left").select(
        "source_id", "outcome", "reason", F.coalesce("chunks", F.lit(0).cast("bigint")).alias("chunks")
    )


def ingest_batch(
    sources: DataFrame,
    held: DataFrame | None = None,
    make_embedder: Callable | None = None,
    partitions: int | None = None,
    index: ChunkIndex | None = None,
) -> Ingested:
    """All sources in one run.

    The verdict comes first. It holds ids only, is stored once in the shared
    folder and serves chunks, outcomes and report alike. Then the accepted texts
    are read, cut and embedded, so nothing rejected reaches the costly steps.
    Point ids derive from source, version and position: a repeated run writes the
    same points again.
    """
    judged = staged(judge(sources, held, index))
    payload = ["source_id", "source_version", "trust_level", "subject", "confession_context", "license_info", "retrieved_at"]
    texts = extract_text(accepted_only(live(sources), judged).withColumn("mime", mime_of("uri")))
    rows = explode_chunks(texts, distinct_chunks(chunk_array("extracted")), payload)
    chunks = rows.withColumn(
        "point_id", F.concat_ws(":", *[F.col(c).cast("string") for c in ("source_id", "source_version", "chunk_index")])
    )
    # counted before the embedding step, so the outcomes never run it a second time
    outcomes = outcomes_of(judged, rows)
    if make_embedder is not None:
        chunks = embed(chunks, make_embedder, partitions=partitions)
    hashes = judged.filter(F.col("outcome") == "ingested").select("source_id", "content_hash")
    return Ingested(chunks, outcomes, ingest_report(outcomes), hashes, judged)


def ingest_and_commit(
    sources: DataFrame,
    index: ChunkIndex,
    registry: DataFrame,
    number: int,
    writer: str = "ingest",
    known_keys: DataFrame | None = None,
    make_embedder: Callable | None = None,
    keep: Callable[[DataFrame], None] | None = None,
) -> Committed:
    """Known keys, gate, duplicates, chunks, embedding, and one commit that publishes all of it.

    ``known_keys`` (ingest_key) are left out before anything is read of their texts. Chunks are embedded
    and written once, to a folder that nobody reads yet. Then ``registry`` is read: of a source
    that is no longer APPROVED in it the chunks of this run are withdrawn, and what it
    served before is left to the revocation. A committed source is marked INGESTED with its content hash,
    and its older chunks make way for the new ones. ``keep`` gets the outcomes before the commit; their
    chunks are counted in the written rows, so no text is cut a second time.
    Runs of a writer are numbered; one that was committed before changes nothing.
    """
    fresh, skipped = sources, None
    if known_keys is not None:
        keys = known_keys.select("ingest_key").distinct()
        skipped = sources.join(keys, "ingest_key", "left_semi").select(
            "source_id", F.lit("skipped").alias("outcome"), F.lit("KNOWN_KEY").alias("reason"), F.lit(0).cast("bigint").alias("chunks")
        )
        fresh = sources.join(keys, "ingest_key", "left_anti")
    run = ingest_batch(fresh, make_embedder=make_embedder, index=index)
    written = index.stage(run.chunks, writer, number)
    prepared = index.prepare(writer, number, written, run.hashes, registry)
    marked = outcomes_of(run.judged, written[1]).join(prepared.withdrawn.withColumn("_late", F.lit(True)), "source_id", "left")
    outcomes = marked.select(
        "source_id",
        F.when(F.col("_late"), F.lit("failed")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(F.col("_late"), F.lit("NOT_APPROVED_ANY_MORE")).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("_late"), F.lit(0).cast("bigint")).otherwise(F.col("chunks")).alias("chunks"),
    )
    if skipped is not None:
        outcomes = outcomes.unionByName(skipped)
    outcomes = staged(outcomes)
    if keep is not None:
        keep(outcomes)
    index.commit(writer, number, prepared)
    marks = prepared.done.select("source_id", F.col("content_hash").alias("_hash"))
    updated = registry.join(marks, "source_id", "left").select(
        *(
            F.when(F.col("_hash").isNotNull(), F.lit("INGESTED")).otherwise(F.col(c)).alias(c)
            if c == "lifecycle_status"
            else F.coalesce("_hash", c).alias(c)
            if c == "content_hash"
            else F.col(c)
            for c in registry.columns
        )
    )
    return Committed(updated, outcomes, ingest_report(outcomes))
