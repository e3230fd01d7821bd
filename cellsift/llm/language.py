"""Language identification by compression: the language whose dictionary makes the text smallest."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_rows, remainder, table, texts

#: A dictionary is of about so many training documents at most, of each a passage of so many code points.
DOCS_PER_LANGUAGE, PASSAGE = 64, 2048
#: Texts are compressed in parts of so many bytes, each with the dictionary at hand: a long text would be its own dictionary.
PART = 4096
LEVEL = 6
#: The second best size must be so much larger than the best.
MARGIN = 0.01
MOST_LANGUAGES = 500


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw content by language in lower case, from a bounded sample of the rows with a language and a text, spread over all of them.

    More than MOST_LANGUAGES values are an error: each text is compressed once for each.
    """
    rows = docs.where("lang IS NOT NULL AND length(text) > 0").select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, DOCS_PER_LANGUAGE / n)))])[F.col("lang")]
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("passage"))
    start = F.pmod(key, F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1).cast("int") + 1
    picked = rows.where(F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate).select("lang", "doc_id", F.substring("text", start, F.lit(PASSAGE)).alias("passage"))
    found: dict[str, list] = {}
    for r in picked.collect():
        found.setdefault(r["lang"], []).append((str(r["doc_id"]), r["passage"]))
    return {k: "\n".join(p for _, p in sorted(found[k])).lower().encode() for k in sorted(found)}


class Compressors:
    def __init__(self, raw: dict[str, bytes]):
        self.names = sorted(raw)
        self.each = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(raw[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.each]

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, confidence, margin; ties go to the first name."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        order = sorted(zip(self.sizes(text), self.names, strict=True))
        if len(order) == 1:
            return order[0][1], 1.0, 1.0
        margin = 1 - order[0][0] / order[1][0]
        return order[0][1], min(1.0, margin * 5), margin


def identify(docs: DataFrame, raw: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, accepted: a row for each input row.

    lang_pred is the language with the smallest result whatever the margin, und for null texts and texts
    without letters (Unicode's category L); accepted is false for those and where the margin is below the
    given one. Texts are read whole, in parts of PART bytes. Repeated rows get a row each, null ids too. Extra
    columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def make():
        compressors = Compressors(shared.value)

        def step(batch: pa.RecordBatch) -> dict:
            got = [compressors.decide(t) for t in texts(batch)]
            return {"doc_id": batch.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "accepted": [g[0] != "und" and g[2] >= margin for g in got]}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double, accepted boolean")


def op7_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs, dictionaries(docs.where(F.coalesce(remainder("doc_id", 4) != 2, F.lit(True)))))
    return got.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
