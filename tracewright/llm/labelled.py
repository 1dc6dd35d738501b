"""Bounded, reproducible samples of texts to train classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out

#: Bytes of all texts of a sample of one kind (or label), at most. Scores always take whole texts.
TRAIN_BYTES = 16 << 20


def _texts(texts: DataFrame, ids: DataFrame, limits: dict[int, int], most_bytes: int) -> list[tuple[int, bytes]]:
    """(kind, text) of at most limits[kind] texts of each kind, in order of their ids. texts: id, t binary; ids: of, kind,
    as many rows as the limits sum to, at most.

    Ids, sizes and digests come to the driver first: of an id with several texts the smallest is taken, and a text that
    would lift its kind above most_bytes is passed over. So what is collected is bounded, whatever the table holds.
    """
    few = F.broadcast(ids)
    met = texts.join(few, F.col("id").eqNullSafe(F.col("of"))).select("id", "kind", F.struct(F.octet_length("t").cast("long").alias("size"), F.xxhash64("t").alias("digest")).alias("x"))
    found = met.groupBy("id", "kind").agg(F.min("x").alias("x")).select("id", "kind", "x.size", "x.digest", F.xxhash64("id").alias("h")).collect()
    room, chosen = dict.fromkeys(limits, most_bytes), []
    for r in sorted(found, key=lambda r: (r["h"], r["id"] is None, r["id"] or 0, r["kind"])):
        if r["size"] <= room[r["kind"]]:
            room[r["kind"]] -= r["size"]
            chosen.append((r["id"], r["kind"], r["digest"]))
    if not chosen:
        return []
    wanted = F.broadcast(texts.sparkSession.createDataFrame(chosen, "of long, kind int, digest long"))
    rows = texts.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.xxhash64("t") == F.col("digest"))).groupBy("id", "kind").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["kind"]))
    for k, r in enumerate(rows):  # a text is not held twice
        rows[k] = r["kind"], bytes(r["t"])
    return rows


def first_texts(texts: DataFrame, n: int, most_bytes: int = TRAIN_BYTES) -> list[bytes]:
    """At most n texts, the first by a hash of the id, of most_bytes together at most. texts: id long, t binary."""
    drawn = texts.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    return [t for _, t in _texts(texts, drawn.select(F.col("id").alias("of"), F.lit(0).alias("kind")), {0: n}, most_bytes)]


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, limits: dict[int, int], id_col: str = "doc_id", text_col: str = "text", fold: int = 5, most_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most limits[label] documents of each label, the first by a hash of the id, and of at most
    most_bytes each label together.

    Held-out documents (crc32 of the id modulo fold is 0), null ids and labels and null or empty texts are not taken.
    """
    own = labels.select(F.col(id_col).cast("long").alias("of"), F.col(label_col).cast("int").alias("kind")).where(F.col("of").isNotNull() & F.col("kind").isNotNull())
    own = own.where(~held_out("of", fold))
    few = None
    for y, n in limits.items():
        part = own.where(F.col("kind") == y).distinct().orderBy(F.xxhash64("of"), "of").limit(n)
        few = part if few is None else few.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).where(F.octet_length("t") > 0)
    rows = _texts(texts, few.dropDuplicates(["of"]), limits, most_bytes)
    return [t for _, t in rows], [y for y, _ in rows]
