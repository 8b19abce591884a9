"""Toxicity by compression distance to two zstandard dictionaries.

Both dictionaries start with the same content, trained on windows of ordinary text. The toxic one goes on with content
trained on toxic text; what ordinary texts hold about as often is left out of its samples, as it would fill a dictionary
with what compresses both classes alike. Each window of a text is compressed with both. How many bytes the toxic one
saves, over the whole text, goes through thresholds calibrated on labelled rows, by halves, to a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import doc_texts, stored

#: the classifier is fitted on at most this many labelled rows of each class, and on texts up to so many bytes
#: (longer ones are not used for fitting), the rows with the smallest hash of their id
PER_CLASS, FIT_BYTES = 4_000, 20_000
N_SAVINGS = 5
WINDOW, STEP = 64, 48
#: sizes of both dictionaries' contents, and the sizes of segments and of what they share that the trainer goes by
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 1_024
ORDINARY_SEGMENT, TOXIC_SEGMENT, SHARED = 32, 16, 6
#: a word belongs to the toxic samples when at least this share of the toxic texts and OWN_TEXTS of them hold it, and a
#: share OWN_RATIO times that of the ordinary ones
OWN_SHARE, OWN_TEXTS, OWN_RATIO = 0.02, 3, 4
#: the share of ordinary texts that may score 0.5 or more
FALSE_ALARMS = 0.02
_HEADER = 256  # entropy tables in front of a trained dictionary's content
_TEXT_WORD = re.compile(rb"[^\s.,;:!?|\"'()\[\]{}]+")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


def held_out():
    """The rows that labels are not learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # matches of five bytes and more: shorter ones are chance
    settings = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=5, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0, write_checksum=0
    )
    content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


def windows(text: str, step: int = STEP) -> list[bytes]:
    """All of a text in pieces of WINDOW bytes that begin every `step` bytes."""
    raw = text.encode()
    return [raw[at : at + WINDOW] for at in range(0, max(1, len(raw) - (WINDOW - step)), step)] if raw else []


def savings(text: str, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[float, ...]:
    """What the toxic dictionary saves over a text's windows: most, mean of the top three, mean, two sums of the large."""
    saved = sorted((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)), reverse=True)
    if not saved:
        return (0.0,) * N_SAVINGS
    n, large = len(saved), sum(v for v in saved if v > 3)
    return float(saved[0]), sum(saved[:3]) / 3, sum(saved) / n, large / math.sqrt(n), math.log1p(large)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Train the dictionaries and the calibration on (text, toxic) rows."""
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    # folds: content from one half must not be calibrated on itself
    half = [(toxic[k::2], ordinary[k::2]) for k in range(2)]
    points, ys = [], []
    for k in range(2):
        machines = [_compressor(c) for c in _contents(*half[k])]
        for y, texts in ((1, half[1 - k][0]), (0, half[1 - k][1])):
            points += [savings(t, *machines) for t in texts]
            ys += [y] * len(texts)
    x, y = np.array(points, float).reshape(-1, N_SAVINGS), np.array(ys, float)
    weights, means, scales = _logistic(x, y)
    if toxic and ordinary:  # the score 0.5 stands where FALSE_ALARMS of the ordinary texts are above
        z = ((x[y == 0] - means) / scales) @ np.array(weights[1:])
        weights = (-float(np.quantile(z, 1 - FALSE_ALARMS)) - 1e-6, *weights[1:])
    return Model(*_contents(toxic, ordinary), weights, means, scales)


def _contents(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    base = _trained([w for t in ordinary for w in windows(t, WINDOW)], ORDINARY_BYTES, ORDINARY_SEGMENT)
    return base, base + _trained(_own_text(toxic, ordinary), TOXIC_BYTES, TOXIC_SEGMENT)


def _own_text(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The toxic texts without the words that they share with ordinary ones or with too few toxic ones."""
    words = [_TEXT_WORD.findall(t.encode().lower()) for t in toxic]
    seen = Counter(w for ws in words for w in set(ws))
    usual = Counter(w for t in ordinary for w in set(_TEXT_WORD.findall(t.encode().lower())))
    least = max(OWN_TEXTS, OWN_SHARE * len(toxic))
    own = {w for w, n in seen.items() if n >= least and n * max(1, len(ordinary)) > OWN_RATIO * (usual[w] + 1) * len(toxic)}
    kept = (b" ".join(w for w in ws if w in own) for ws in words)
    return [b" " + k + b" " for k in kept if k]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Dictionary content of at most `size` bytes; samples too few to fill half of it are used as they are."""
    try:
        content = zstandard.train_dictionary(size + _HEADER, samples, k=segment, d=SHARED).as_bytes()[_HEADER:]
    except zstandard.ZstdError:
        content = b""
    return content if len(content) >= size // 2 else b"".join(dict.fromkeys(samples))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], ...]:
    """Newton steps on a slightly penalised logistic loss."""
    if not len(x) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        odds = math.log((share + 1e-3) / (1 - share + 1e-3))
        return (odds, *(0.0,) * N_SAVINGS), (0.0,) * N_SAVINGS, (1.0,) * N_SAVINGS
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - means) / scales])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), gradient)
    return tuple(w.tolist()), tuple(means.tolist()), tuple(scales.tolist())


def score(text: str, model: Model, machines: list[zstandard.ZstdCompressor]) -> float:
    x = (np.array(savings(text, *machines)) - model.means) / model.scales
    z = model.weights[0] + float(x @ np.array(model.weights[1:]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    )
    return known.where(~held_out()).distinct()


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic) of at most PER_CLASS rows of each class."""
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for y in (0, 1)]
    picked = stored(parts[0].unionByName(parts[1]), "labelled")
    rows = doc_texts(docs).join(F.broadcast(picked), "doc_id")  # at most 2 * PER_CLASS ids
    return rows.where(F.octet_length("text") <= FIT_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic").limit(4 * PER_CLASS)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null counts as the empty text, which has a score too.

    Without labels of both classes the score is the share of toxic labels, or near 0 without any.
    """
    known = known_labels(labels)
    rows = list(dict.fromkeys((r["text"], r["toxic"]) for r in training_rows(docs, known).collect()))
    model = fit(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [_compressor(model.ordinary), _compressor(model.toxic)]
        for batch in rows:
            scores = [score(t.as_py(), model, machines) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    out = doc_texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
