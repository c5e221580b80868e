"""Language identification by compression.

Texts are reduced to letters in lower case and single spaces. For each language a zstandard dictionary
of raw text is put together from labelled documents. A text is cut into pieces of ``PIECE_BYTES``, each piece
is compressed with every dictionary, and the language whose dictionary gives the fewest bytes over
the whole text is chosen. Texts on which the best dictionaries tie, which are very short ones, are
compressed with many small slices of the training text instead, where a match is cheaper to refer to. The score is
the share of bytes saved against the second best; a text whose score is below ``margin`` is rejected.

The labelled rows used are bounded: ``docs_per_language`` documents of every language, chosen by a
hash of their id, and of each at most ``PASSAGE_CHARS`` characters from a hashed place, until ``TRAINING_BYTES``
are full. Prediction reads every text whole and sees nothing but the text.

Cases: null texts and texts without a letter get ``und``, score 0, and are rejected; so is everything
if no document is labelled. Ties that remain go to the language first in the alphabet, with score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.units import small_batches

TRAINING_BYTES, DOCS_PER_LANGUAGE, PASSAGE_CHARS = 131_072, 400, 1_000
#: Of that, the dictionary, the slices for ties, and the piece of text that is compressed at once.
DICTIONARY_BYTES, SLICE_BYTES, PIECE_BYTES, LEVEL = 16_384, 4_096, 512, 6
#: Least share of bytes saved against the second best language.
MARGIN = 0.005
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Letters in lower case, everything else as single spaces."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def fit(
    df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", training_bytes: int = TRAINING_BYTES, docs_per_language: int = DOCS_PER_LANGUAGE
) -> dict[str, bytes]:
    """Training text for each language among the rows with text and language."""
    order = F.xxhash64(F.lit("language"), F.col(id))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    start = F.pmod(F.col("order"), F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = (
        df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("order"))
        .where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
        .select("lang", "order", F.col("text").substr(start, F.lit(PASSAGE_CHARS)).alias("text"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= docs_per_language)
        .orderBy("lang", "rank")
        .select("lang", "text")
        .collect()
    )
    passages: dict[str, dict[str, None]] = {}
    for row in rows:
        passages.setdefault(row.lang, {}).setdefault(row.text)
    return {l: b"".join(map(letters, reversed(found)))[-training_bytes:] for l, found in sorted(passages.items())}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=PIECE_BYTES, min_match=3, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False
    )
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=parameters)


class Predictor:
    def __init__(self, training: dict[str, bytes], margin: float):
        self.margin = margin
        self.whole = {lang: [_compressor(content[-DICTIONARY_BYTES:])] for lang, content in training.items()}
        slices = min((len(content) // SLICE_BYTES for content in training.values()), default=0)
        self.slices = {
            lang: [_compressor(content[at * SLICE_BYTES : (at + 1) * SLICE_BYTES]) for at in range(slices)] for lang, content in training.items()
        }

    @staticmethod
    def _sizes(by_language: dict[str, list], data: bytes) -> list[tuple[int, str]]:
        pieces = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]
        return sorted((sum(len(c.compress(p)) for c in compressors for p in pieces), lang) for lang, compressors in by_language.items())

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.whole or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        data = letters(text)
        sizes = self._sizes(self.whole, data)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        if sizes[0][0] == sizes[1][0] and next(iter(self.slices.values())):
            sizes = self._sizes(self.slices, data)
        score = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], score, score >= self.margin


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``accepted``, which take the place of columns of that name."""
    shared = df.sparkSession.sparkContext.broadcast((dictionaries, margin))
    names = ("lang_pred", "score", "accepted")
    rest = df.drop(*names)
    fields = rest.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2])).schema
    column = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = None
        for whole in batches:
            for batch in small_batches(whole):
                predictor = predictor or Predictor(*shared.value)
                found = [predictor(t) for t in batch.column(column).to_pylist()]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=fields.names)

    return rest.mapInArrow(run, fields)


def held_out(id: str | Column = "doc_id") -> Column:
    """The fold that learning leaves out: CRC-32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))
