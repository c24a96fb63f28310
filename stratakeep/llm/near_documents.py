"""MinHash near-dedup of documents by min-max hashing (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakeep.llm.links import band_keys, linked, min_max, multipliers
from stratakeep.llm.store import materialise, observed
from stratakeep.llm.wanted import asked_for, bitmap, bits_for
from stratakeep.llm.words import chunks, mix, shingle_sets

PERMUTATIONS, BAND_ROWS = 224, 7


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set, whatever the order of its elements."""
    total = np.array([np.bitwise_xor.reduce(s), mix(s * np.uint64(3)).sum(dtype=np.uint64), len(s)], np.uint64)
    return int(mix(mix(mix(total[:1]) ^ total[1:2]) ^ total[2:])[0].view(np.int64))


def _signed(shingle: int, permutations: int, rows: int):
    by = multipliers(permutations)

    def run(batches):
        for batch in chunks(batches, "text"):
            n, ids, bands = [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                bands.append(band_keys(min_max(s, by), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "id", "bands"])

    return run


def _sets(shingle: int, wanted):
    def run(batches):
        for batch in chunks(batches, "text"):
            batch = batch.filter(pa.array(asked_for(wanted, batch.column(0).to_numpy())))
            sets = [s for s in shingle_sets(batch.column(1), shingle) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "body"])

    return run


def near_documents(docs: DataFrame, shingle: int = 5, threshold: int = 80, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs (doc_id, text).

    Two documents are linked when 100 * |A & B| >= threshold * |A | B| for their sets of distinct
    word shingles (A-Z in lower case, words end at ASCII white space; fewer words than a shingle:
    the whole sequence). component_id is the least doc_id reachable, kept marks it.

    224 permutations give 448 values, in 64 bands of 7: a pair at J = 0.8 shares no band with
    probability (1 - 0.8 ** 7) ** 64 = 3e-7, while one at J = 0.3 is a candidate in 1.4 of 100
    cases. Documents with equal sets are one node, whose id is a 64-bit hash of the set; among n
    different sets n * n / 2 ** 65 pairs share one by chance. Only one document of a node takes
    part in the search.

    Null and empty texts have no shingles and no links, and stay as they are. Rows with a null
    doc_id are kept out of linking: component_id null, kept true. Rows are documents: those of one
    doc_id come back as many times as they came, and where their texts differ each is linked by
    its own. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(_signed(shingle, permutations, rows), "doc_id long, n long, id long, bands array<long>"), "signed")
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    nodes = signed.where(usable).groupBy("id").agg(F.min("doc_id").alias("least_doc"), F.first("bands").alias("bands"))
    nodes, about = observed(nodes, "nodes", keys=F.sum(F.size("bands")))

    def bodies_of(ids: DataFrame, n: int) -> DataFrame:
        slot = F.xxhash64("doc_id")
        wanted = bitmap(nodes.join(ids, "id").select(F.col("least_doc").alias("doc_id")), slot, bits_for(n))
        found = texts.where(F.col("doc_id").isNotNull()).select(slot.alias("slot"), "text").mapInArrow(_sets(shingle, wanted), "id long, body binary")
        return found.dropDuplicates(["id"]).join(ids, "id", "left_semi")

    groups = linked(nodes.select("id", "bands"), about["keys"] or 0, bodies_of, threshold)
    placed = nodes.join(groups, "id", "left").select("id", "least_doc", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("least_doc").alias("component_doc"))
    placed = placed.join(least, "component").select("id", "component_doc")
    out = signed.select("doc_id", "n", F.when(usable, F.col("id")).alias("id"))
    out = out.join(placed, "id", "left")
    component = F.coalesce("component_doc", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
