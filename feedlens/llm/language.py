"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import parts_of

UNKNOWN = "und"
#: Different labelled texts per language that a fit may read, and characters taken of all of them together.
FIT_ROWS = 400
DICTIONARY_BYTES = 64 * 1024
LEVEL = 6
#: Below this lead the sizes of a second, finer coding are added to the first.
SECOND_LOOK = 0.05
SECOND_LEVEL = 12
#: Characters coded by themselves, so that a long text can't become its own dictionary.
BLOCK = 2048
#: Relative lead over the second-best language below which the answer is marked as rejected.
MIN_MARGIN = 0.002

_RANGE = 1 << 40
_SPACES = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower-case words joined by single spaces; digits, punctuation and symbols go."""
    return _SPACES.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class LanguageModel:
    """One dictionary of raw text per language, equally long, in the order of the language names."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def fit_languages(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, size: int = DICTIONARY_BYTES
) -> LanguageModel:
    """Dictionaries from at most ``rows`` different texts of each language, those with the lowest hash.

    Rows without text or language are ignored and equal texts count once. Every sampled text lends
    ``4 * size / rows`` characters in a row, from a place that its hash draws over the whole text, so long
    ones don't crowd out others: at most ``4 * size`` characters of a language reach the driver. All dictionaries are as long as the longest; a shorter language's text is repeated.
    """
    share = max(64, 4 * size // rows)
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("whole")).withColumn("h", F.xxhash64("whole"))
    # the same number of characters of every sampled text: a bounded sample of labelled rows, used in the fit alone
    places = F.greatest(F.length("whole") - share, F.lit(0)) + 1
    part = F.substring("whole", (F.pmod("h", places) + 1).cast("int"), F.lit(share))
    # copies count once: equal rows of a task are one before anything is shuffled
    counts = usable.select("lang", "h").distinct().groupBy("lang").count().collect()  # one row per language
    if not counts:
        return LanguageModel((), ())
    # about four times the wanted texts of each language pass, so the texts that are shuffled don't grow with the table
    bound = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(_RANGE, 4 * rows * _RANGE // r["count"] + 1))])
    some = usable.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(_RANGE)) < bound[F.col("lang")])
    some = some.select("lang", "h", part.alias("text")).distinct()
    ranked = some.withColumn("r", F.expr("row_number() over (partition by lang order by h, text)"))
    found = ranked.where(F.col("r") <= rows).select("lang", "r", "text").collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in found:
        texts.setdefault(row["lang"], []).append((row["r"], letters_only(row["text"])))
    joined = {lang: " ".join(t for _, t in sorted(parts) if t).encode()[:size] for lang, parts in texts.items()}
    joined = {lang: text for lang, text in joined.items() if text}
    languages = tuple(sorted(joined))
    # a longer dictionary alone would win, and a language with little text takes nothing from the others
    longest = max((len(t) for t in joined.values()), default=0)
    return LanguageModel(languages, tuple(repeated(joined[lang], longest) for lang in languages))


def repeated(text: bytes, size: int) -> bytes:
    """``text`` again and again, a space between, up to ``size`` bytes."""
    return ((text + b" ") * (size // (len(text) + 1) + 1))[:size]


class Classifier:
    """Coded sizes of texts under each language's dictionary."""

    def __init__(self, model: LanguageModel, levels: tuple[int, int] = (LEVEL, SECOND_LEVEL)):
        self.model = model
        self.coders = [[self._coder(raw, level) for raw in model.dictionaries] for level in levels]

    @staticmethod
    def _coder(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: str, look: int = 0) -> list[int]:
        """Coded bytes of the whole text per language, block by block."""
        raw = [text[i : i + BLOCK].encode() for i in range(0, len(text), BLOCK)]
        return [sum(len(coder.compress(block)) for block in raw) for coder in self.coders[look]]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """``(language, score, margin)``: the margin is the lead over the second best as a part of its size."""
        clean = letters_only(text) if text else ""
        if not clean or not self.model.languages:
            return UNKNOWN, 0.0, 0.0
        if len(self.model.languages) == 1:
            return self.model.languages[0], 1.0, 1.0
        sizes = self.sizes(clean)
        best, second = np.argsort(sizes, kind="stable")[:2]
        if sizes[second] - sizes[best] < SECOND_LOOK * sizes[second]:
            sizes = [a + b for a, b in zip(sizes, self.sizes(clean, 1), strict=True)]
            best, second = np.argsort(sizes, kind="stable")[:2]
        lead = sizes[second] - sizes[best]
        # each byte saved doubles the odds; 0.5 where two languages do equally well
        return self.model.languages[best], 1.0 / (1.0 + 2.0 ** -min(lead, 60)), lead / sizes[second]


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
    min_margin: float = MIN_MARGIN, keep: list[str] | None = None,
) -> DataFrame:
    """``(id, keep..., lang_pred, score, margin, rejected)``, one row per input row, in one narrow pass over whole texts.

    A text that is null or has no letter is ``und`` with score 0 and rejected. Otherwise the
    language whose dictionary codes the text in the fewest bytes is given, the first by name
    among equals, and ``rejected`` tells that its lead is below ``min_margin``. A null id stays null,
    repeated rows get equal answers, very long texts are coded in blocks, an empty table gives no rows
    and columns that aren't named in ``keep`` are left out. A kept column named like an answer is an error.
    """
    kinds = dict(docs.dtypes)
    kept = [id_col, *(keep or [])]
    if clash := {c.lower() for c in kept} & {"lang_pred", "score", "margin", "rejected"}:
        raise ValueError(f"kept columns are named like answers: {sorted(clash)}")
    text_at = kept.index(text_col) if text_col in kept else len(kept)
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x DICTIONARY_BYTES

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(held.value)
        for batch in parts_of(batches):
            found = [classifier.classify(t) for t in batch.column(text_at).to_pylist()]
            lang, score, margin = zip(*found, strict=True) if found else ((), (), ())
            rejected = [m < min_margin for m in margin]
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, "lang_pred", "score", "margin", "rejected"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", lang_pred string, score double, margin double, rejected boolean"
    whole = [] if text_col in kept else [F.col(text_col).cast("string").alias("_text")]
    return docs.select(*[F.col(c) for c in kept], *whole).mapInArrow(classify, schema)
