"""Language spans by Viterbi over word scores, with candidates narrowed by script."""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of

SAMPLE_PER_LANGUAGE = 1_000
MAX_GRAMS = 50_000
SWITCH = 8.0
FLOOR = 0.02
MIN_SCRIPT_SHARE = 0.02
UNKNOWN = "und"
SPANS = "array<struct<lang:string,start:long,end:long>>"

# First and last code point of the main blocks of each script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF), ("syriac", 0x0700, 0x074F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)


BLOCK = 1 << 16
BITS = 21


def script_of(code: int) -> int:
    """Place of the script of a code point in SCRIPT_NAMES; 0 stands for any other."""
    return next((SCRIPT_NAMES.index(name) for name, first, last in SCRIPTS if first <= code <= last), 0)


SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


class Letters:
    """Tables of the first 65 536 code points: letter or not, lower case, script."""

    def __init__(self):
        self.alpha = np.array([chr(c).isalpha() for c in range(BLOCK)])
        self.lower = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(BLOCK)], np.uint64)
        self.script = np.zeros(BLOCK, np.int64)
        for name, first, last in SCRIPTS:
            self.script[first:last + 1] = SCRIPT_NAMES.index(name)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of letters, the script of each, and a key for each letter.

        The key holds the lower-cased letter between its neighbours, 0 for a neighbour that is no letter.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        low = np.minimum(codes, BLOCK - 1)
        alpha, small, script = self.alpha[low], self.lower[low], self.script[low]
        if len(codes) and codes.max() >= BLOCK:
            for i in np.flatnonzero(codes >= BLOCK):
                alpha[i], small[i], script[i] = text[i].isalpha(), codes[i], script_of(int(codes[i]))
        edge = np.diff(np.concatenate([[0], alpha.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        around = np.concatenate([[0], np.where(alpha, small, 0), [0]]).astype(np.uint64)
        keys = (around[:-2] << np.uint64(2 * BITS)) | (around[1:-1] << np.uint64(BITS)) | around[2:]
        return starts, ends, script[starts], keys[alpha]


@dataclass
class Model:
    """Log-probabilities of letter triples by language, and which languages write which script.

    ``keys`` are the known triples in order, ``scores`` their rows by language, with a last row for
    unknown ones; ``writes[script, language]`` says whether the language uses the script.
    """

    languages: list[str]
    keys: np.ndarray
    scores: np.ndarray
    writes: np.ndarray

    def word_scores(self, sizes: np.ndarray, script: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Log-posterior of each language for each word alone.

        Languages that do not write the word's script get the floor; a word in a script of no language
        is equally likely in all.
        """
        n = len(self.languages)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place[self.keys[place] != keys] = len(self.keys)
        total = np.add.reduceat(self.scores[place], np.cumsum(sizes) - sizes, axis=0)
        allowed = self.writes[script]
        total = np.where(allowed, total, -np.inf)
        total[~allowed.any(1)] = 0.0
        chance = np.exp(total - total.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        return np.log((chance + FLOOR) / (1 + n * FLOOR))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path, where each change of language costs ``switch``.

    If the best single language is never outscored by ``switch / 2`` over any run of words, no path
    with a change can be better, and the search is skipped.
    """
    best = int(scores.sum(0).argmax())
    lead = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum(np.minimum.accumulate(lead, axis=0), 0.0)
    if (lead - np.vstack([np.zeros(scores.shape[1]), low[:-1]])).max() <= switch / 2:
        return np.full(len(scores), best)
    total = scores[0].tolist()
    back = []
    for row in scores[1:].tolist():
        top = max(total)
        origin = total.index(top)
        change = top - switch
        back.append([j if own >= change else origin for j, own in enumerate(total)])
        total = [(own if own >= change else change) + s for own, s in zip(total, row)]
    state = total.index(max(total))
    path = [state]
    for origins in reversed(back):
        state = origins[state]
        path.append(state)
    return np.array(path[::-1])


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit letter-triple counts on (text, language) rows; a repeated text counts once per language."""
    counts: dict[str, Counter] = defaultdict(Counter)
    written: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(SCRIPT_NAMES)))
    letters = Letters()
    for language, text in sorted({(language, text) for text, language in rows}):
        starts, ends, script, keys = letters.words(text)
        if len(starts):
            found, n = np.unique(keys, return_counts=True)
            counts[language].update(dict(zip(found.tolist(), n.tolist())))
            written[language] += np.bincount(script, ends - starts, len(SCRIPT_NAMES))
    languages = sorted(counts)
    if not languages:
        return Model([], np.empty(0, np.uint64), np.empty((1, 0)), np.empty((len(SCRIPT_NAMES), 0), bool))
    kept = sorted({t for language in languages for t, _ in counts[language].most_common(MAX_GRAMS)})
    table = np.array([[counts[g][t] for g in languages] for t in [*kept, None]], float)
    scores = np.log((table + 0.5) / (table + 0.5).sum(0))
    writes = np.array([written[g] >= MIN_SCRIPT_SHARE * written[g].sum() for g in languages])
    return Model(languages, np.array(kept, np.uint64), scores, writes.T)


def train_on(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> Model:
    """Fit on a bounded sample: about ``per_language`` documents of each language of the training fold.

    The fold is every id whose crc32 as text modulo 3 is not 1. Rows without text, language or id are
    left out.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & (fold_of(F.col("id")) != 1))
    sample = bounded_sample(rows, "lang", "id", per_language)
    return train([(r["text"], r["lang"]) for r in sample.select("text", "lang").collect()])


def label_text(text: str, model: Model, letters: Letters) -> tuple[str, float, list[dict]]:
    """Main language, its share of the letters, and the spans of a text."""
    starts, ends, script, keys = letters.words(text)
    if not len(starts) or not model.languages:
        return UNKNOWN, 0.0, []
    sizes = ends - starts
    scores = model.word_scores(sizes, script, keys)
    path = viterbi(scores)
    main = int(np.bincount(path, sizes, len(model.languages)).argmax())
    telling = (path == main) & model.writes[script, main]
    changes = np.flatnonzero(np.diff(path)) + 1
    spans = [
        {"lang": model.languages[path[lo]], "start": int(starts[lo]), "end": int(ends[hi - 1])}
        for lo, hi in zip([0, *changes], [*changes, len(path)])
    ]
    return model.languages[main], float(sizes[telling].sum() / sizes.sum()), spans


def identify_languages(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id, lang_pred, score, spans``.

    Words are runs of letters. Each word's script narrows the candidate languages; the best path over
    the words' scores, with a penalty for each change, labels spans (code points, end exclusive). The
    language of most letters is predicted, ties to the first in order of name; the score is the share
    of letters labelled so in a script which the language writes. Null texts, texts without a
    letter and models without languages give ``und``, score 0 and no spans. Whole texts are read,
    repeated rows get the same result, other columns are ignored, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        item = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [label_text(value.as_py() or "", model, letters) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], item),
            ], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(
        run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, spans {SPANS}"
    )
