"""Language ID (operator 5): classification by compression against per-language zstandard raw-content dictionaries.

Training: of the documents given, each language gets one dictionary, the concatenation of sampled texts. The sample is
bounded: for each language and each of SLOTS hash slots, the text with the least hash of its content among those of
SAMPLE_CHARS characters (or, in a slot that has none, any, of which as much as a dictionary holds), joined up to
DICTIONARY_BYTES, or less where more languages share MODEL_BYTES. It depends on texts and languages alone, and is computed by
one aggregation that combines on the map side. Pieces of one half of the sample that the other half's dictionaries take for
another language (quotations, mixed texts) are left out.

Prediction: a whole text is compressed against each dictionary; the smallest output wins, ties go to the first language
by name. score is a soft maximum over the bits per byte. ``rejected`` tells that the margin to the runner-up is below
MARGIN (short or mixed texts); lang_pred stays the best guess. A null text, or one without a letter, is ``und`` with
score 0. Without a training document of a known language every text is ``und``. Repeated rows are predicted alike; a null
doc_id is like any other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import lean, table

SLOTS = 64
SAMPLE_CHARS = (500, 4000)
DICTIONARY_BYTES = 96 * 1024
#: All dictionaries are broadcast: what they take together. A lang column of more than LANGUAGES values is taken for something else, and refused.
MODEL_BYTES = 30 << 20
LANGUAGES = 20_000
LEVEL = 9
MARGIN = 0.01
SHARPNESS = 12.0
#: Words of a sampled text that are judged together.
PIECE = 40
#: zstandard stores inputs of a few bytes as they are; a shorter text follows so many bytes of the dictionary.
SHORT = 512
_MARKS = (string.digits + string.punctuation).encode()
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """What is compressed: the whole text in lower case, without ASCII digits and punctuation, which tell no languages apart."""
    return text.lower().encode().translate(None, _MARKS) or b" "


def train(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, from docs(text, lang)."""
    text = F.col("text")
    usual = F.length("text").between(*SAMPLE_CHARS)
    rows = docs.where("text is not null and lang is not null and text <> ''").select("lang", F.substring("text", 1, DICTIONARY_BYTES).alias("text"), F.pmod(F.xxhash64(text, F.lit(1)), F.lit(SLOTS)).alias("slot"), F.struct(F.when(usual, 0).otherwise(1).alias("odd"), F.xxhash64(text, F.lit(2)).alias("h")).alias("key"))
    names = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if names > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    most = min(DICTIONARY_BYTES, MODEL_BYTES // max(names, 1))
    halves: list[dict[str, list[bytes]]] = [{}, {}]
    for r in rows.groupBy("lang", "slot").agg(F.min(F.struct("key", "text")).alias("best")).orderBy("lang", "best.key.odd", "slot").toLocalIterator():
        texts = halves[r["slot"] % 2].setdefault(r["lang"], [])
        if sum(map(len, texts)) < most:
            words = plain(r["best"]["text"][:most]).split()
            texts.extend(b" ".join(words[i : i + PIECE]) for i in range(0, len(words), PIECE))
    # each half is judged by the other one's dictionaries: passages in another language go
    judges = [classifier({k: b" ".join(v)[:most] for k, v in h.items()}) for h in halves]
    out: dict[str, bytes] = {}
    for lang in sorted({*halves[0], *halves[1]}):
        kept: list[bytes] = []
        for i in (0, 1):
            texts = halves[i].get(lang, [])
            good = [t for t in texts if lang not in halves[1 - i] or judges[1 - i](t.decode(errors="ignore"))[0] == lang]
            kept += dict.fromkeys(good or texts)
        out[lang] = b" ".join(kept)[:most]
    return out


def classifier(dictionaries: dict[str, bytes]):
    """text -> (language, score, rejected)."""
    names = sorted(dictionaries)
    presses, leads = [], []
    for k in names:
        d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        leads.append(dictionaries[k][-SHORT:])
        presses.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def classify(text: str | None) -> tuple[str, float, bool]:
        if not names or text is None or not _LETTER.search(text):
            return "und", 0.0, True
        raw = plain(text)
        bits = [8.0 * len(p.compress(raw if len(raw) >= SHORT else lead + raw)) / len(raw) for p, lead in zip(presses, leads, strict=True)]
        best = min(range(len(names)), key=bits.__getitem__)
        rest = [b for i, b in enumerate(bits) if i != best]
        share = 1.0 / (1.0 + sum(math.exp(SHARPNESS * (bits[best] - b)) for b in rest))
        return names[best], share, bool(rest) and min(rest) - bits[best] < MARGIN * bits[best]

    return classify


def predict(docs: DataFrame, dictionaries: dict[str, bytes], *keep: str) -> DataFrame:
    """The columns ``keep``, lang_pred, score, rejected, for every row of docs(text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or "text" in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(shared.value)
        for b in batches:
            made = [classify(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(lean(run), f"{schema}, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = train(docs.where("not held_out").select("text", "lang"))
    return predict(docs, model, "doc_id", "held_out")
