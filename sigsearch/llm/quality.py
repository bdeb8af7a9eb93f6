"""Quality scores learnt from preferences: Bradley-Terry on pairs of labelled documents.

Each pair prefers a row of label 1 to a row of label 0; the chance that it wins is the logistic function of the
weighted difference of their features.  The weights are the scores' only parameters.  The score of a document
is then shifted so that 0.7 falls on the quantile of training scores that equals the share of label 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import bounded_sample, ready

CUT = 0.7  # a score from here on predicts label 1
SAMPLE_ROWS = 20_000  # labelled rows the weights are fitted on, at most; chosen by the hash of their id
PAIRS_PER_ROW = 16
RIDGE = 1e-2
WINDOW = 1 << 20  # characters whose words are in memory at once

FEATURES = (
    "log_words", "word_length", "symbols", "symbol_runs", "bare_symbols", "capitals", "shouted", "digits", "distinct",
    "commonest", "stutter", "echo", "repeated_lines", "closed_lines", "short_words", "sentence_length", "empty",
)
_CLOSED = (".", "!", "?", ":", ";", '"', "”", "»", ")")
SPACE, LETTER, UPPER, DIGIT, SYMBOL, END, RUN = 1, 2, 4, 8, 16, 32, 64


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Flags of every character up to U+FFFF; the last stands for all beyond."""
    def of(c: str) -> int:
        other = not (c.isalnum() or c.isspace() or c == "_")
        return (SPACE * c.isspace() | LETTER * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit()
                | SYMBOL * other | END * (c in ".!?") | RUN * (other and c != "."))

    return np.fromiter((of(chr(i)) for i in range(1 << 16)), np.uint8, 1 << 16)


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; they depend on nothing but the text."""
    text = text or ""
    words = lines = letters = upper = shouted = digits = symbols = runs = bare = chars = short = 0
    stutter = echo = ends = closed = repeats = 0
    counts: Counter[str] = Counter()
    grams: set[int] = set()
    line_set: set[int] = set()
    last = ""
    for at in _windows(text):
        code = np.frombuffer(at.encode("utf-32-le", "surrogatepass"), np.uint32)
        flag = _classes()[np.minimum(code, 0xFFFF)]
        ink = flag & SPACE == 0
        begin = np.flatnonzero(ink & np.concatenate(([True], ~ink[:-1])))
        stop = np.flatnonzero(ink & np.concatenate((~ink[1:], [True])))
        letters += (alpha := flag & LETTER != 0).sum()
        upper += (capital := flag & UPPER != 0).sum()
        digits += (flag & DIGIT != 0).sum()
        symbols += (flag & SYMBOL != 0).sum()
        if len(begin):
            in_word = [(c := np.cumsum(x, dtype=np.int32))[stop] - c[begin] + x[begin] for x in (alpha, capital, flag & (LETTER | DIGIT) != 0)]
            shouted += ((in_word[0] > 3) & (in_word[0] == in_word[1])).sum()
            bare += (in_word[2] == 0).sum()
            size = stop - begin + 1
            chars += size.sum()
            short += (size < 4).sum()
            ends += (flag[stop] & END != 0).sum()
        mark = flag & RUN != 0
        runs += (mark[1:] & mark[:-1] & ~np.concatenate(([False], mark[:-2]))).sum() if len(mark) > 1 else 0
        part = at.split()
        words += len(part)
        counts.update(part)
        stutter += sum(map(str.__eq__, [last, *part[:-1]], part))
        last = part[-1] if part else last
        new = list(map(hash, zip(part, part[1:], part[2:], strict=False)))
        echo += len(new)
        grams.update(new)
        for line in filter(None, map(str.strip, at.split("\n"))):
            lines += 1
            closed += line.endswith(_CLOSED)
            h = hash(line)
            repeats += h in line_set
            line_set.add(h)
    n = max(words, 1)
    return np.array([
        np.log1p(words), min(chars / n, 20.0), symbols / max(chars, 1), runs / n, bare / n, upper / max(letters, 1),
        shouted / n, digits / max(chars, 1), len(counts) / n ** 0.75, max(counts.values(), default=0) / n, stutter / n,
        1 - len(grams) / max(echo, 1) if echo else 0.0, repeats / max(lines, 1), closed / max(lines, 1), short / n,
        min(words / max(ends, 1), 60.0), float(not words),
    ])


def _windows(text: str) -> Iterator[str]:
    """Pieces of about WINDOW characters that end at white space."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


@dataclass(frozen=True)
class Model:
    """Centre, scale and weight of every feature, and the score at which label 1 begins."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; CUT where the raw score meets the cut."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -30, 30)) * (1 - CUT) / CUT)


def bradley_terry(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS_PER_ROW, rounds: int = 25) -> Model:
    """Fit on rows of features with labels 0 and 1; without both labels every score is neutral."""
    width = len(FEATURES)
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    centre = x.mean(axis=0)
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.clip((x - centre) / scale, -8, 8)
    rng = np.random.default_rng(0)
    n = pairs * max(len(good), len(poor))
    gap = z[good[rng.permutation(n) % len(good)]] - z[poor[rng.permutation(n) % len(poor)]]
    w = np.zeros(width)
    for _ in range(rounds):  # Newton steps on the ridge-penalised logistic loss
        p = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
        slope = gap.T @ p / n - RIDGE * w
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / n + RIDGE * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = np.sort(z @ w)
    at = len(poor)  # the share of label 0, as a quantile of the scores: between these two rows
    return Model(centre, scale, w, float(raw[at - 1:at + 1].mean()))


def _numbers(rows: DataFrame, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], [column, "x"])

    return rows.mapInArrow(run, f"{column} int, x array<double>")


def held_out(doc_id):
    """Rows that are never learnt from: CRC-32 of the id as text, remainder 2 by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows, held-out rows excepted.

    Labels other than 0 and 1 and ids with contradictory labels are left out; repeated labels count once.
    """
    ready(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("known"), F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & F.col("known").isNotNull() & ~held_out(F.col("known")))
    known = known.groupBy("known").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    chosen = bounded_sample(known, sample_rows, "known").select("known", "quality")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("known"))
    found = _numbers(rows.select("quality", "text"), "quality").collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    y = np.array([r.quality for r in found], int)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows arrive in
    return bradley_terry(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; repeated rows each give a row, other columns are not read.

    A null or empty text has a score like any other.  A null doc_id is kept.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(2)]).reshape(b.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model predicts as label 1, all columns as they are; decided row by row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            x = np.array([features(t.as_py()) for t in b.column(at).cast(pa.string())]).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
