"""Query op12_periodic_runs; it has no SQL, tests hold it against enumeration of all stretches."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, table
from tidemark.llm.periodic_runs import periodic_runs


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In one text of ten, all words from some place on repeat what begins there. A null doc_id leaves the text alone."""
    h = 0 if doc_id is None else crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the repetitions that the query is held to find."""

    def run(rows):
        out = []
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            words = (text or "").encode().split()
            new = planted_words(doc_id, words)
            out.append(text if new is words else b" ".join(new).decode())
        return {"doc_id": rows["doc_id"], "text": out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, text string", run)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.concat_ws("\n", F.concat(lines, F.array(F.lit(""))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(digest.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
