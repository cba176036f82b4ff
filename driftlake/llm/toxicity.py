"""Toxic texts: a support vector machine on a gap-weighted subsequence kernel between words, with Nyström landmarks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.llm.tokens import _pieces

#: Codes of letters: a to z, and OTHERS for all other letters, by their code points.
OTHERS = 4
LETTERS = 26 + OTHERS
SIZE = LETTERS**3
#: Decay per character that a subsequence of three letters spans, and the longest span; words are read in pieces of at most PIECE characters.
DECAY, SPAN, PIECE = 0.6, 8, 24
#: Bound of the sample to learn from: labelled texts of each class, those of the smallest hashes, whole.
TRAIN_TEXTS = 3000
LANDMARKS, NEGATIVES, ROUNDS = 256, 20_000, 3
#: Words that are remembered with their margins, and the bytes of the longest of these.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes of text whose new words are scored together.
TOGETHER = 1 << 20
#: How many deviations, and how many times as often as in clean texts, a word must stand in toxic ones to be a witness for sure.
SURE, PURITY = 3.0, 9
#: Weight of a witness against a word of clean texts, which are many more; and the margins beyond which a word is not more or less toxic.
POSITIVE = 3.0
LEAST, MOST = -1.0, 1.0
#: Rows of a matrix that a training step takes at a time.
ROWS = 2048
_LOOKS_LIKE = str.maketrans("013457@$", "oieastas")
_CODES = bytes((c | 32) - 97 if chr(c | 32) in "abcdefghijklmnopqrstuvwxyz" else LETTERS for c in range(256))
_SPACED = re.compile(rb"(?<!\S)\S(?: \S){2,}(?!\S)")


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j, k) of three letters in a word of n, spanning SPAN at most, and their weights."""
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))], np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def pieces_of(token: bytes) -> list[bytes]:
    """The parts of a token that are compared: codes of its characters, 0 to LETTERS - 1 for letters, LETTERS for what stands between them; ends are stripped of the latter."""
    if token.isascii() and token.isalpha():
        codes = token.translate(_CODES)
        return [codes] if len(codes) <= PIECE else [codes[i : i + PIECE] for i in range(0, len(codes) - PIECE // 2, PIECE // 2)]
    word = token.decode().lower()
    if not word.isalpha():
        a = next((i for i, c in enumerate(word) if c.isalnum()), len(word))
        b = next((i for i in range(len(word), 0, -1) if word[i - 1].isalnum()), 0)
        word = word[a:b].translate(_LOOKS_LIKE)
    codes = bytes(ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % OTHERS if c.isalpha() else LETTERS for c in word)
    if len(codes) <= PIECE:
        return [codes]
    return [codes[i : i + PIECE] for i in range(0, len(codes) - PIECE // 2, PIECE // 2)]


def features(words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words (codes) of each length: their indexes, codes of subsequences (rows x places) and weights, rows scaled so that each word is at length 1."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 3:
            by_length.setdefault(len(w), []).append(i)
    for n, indexes in by_length.items():
        at, weights = _triples(n)
        for part in range(0, len(indexes), 1024):
            idx = np.array(indexes[part : part + 1024])
            letters = np.frombuffer(b"".join([words[i] for i in idx]), np.uint8).reshape(-1, n)
            inner = letters.astype(np.int16)
            code = (inner[:, at[:, 0]] * LETTERS + inner[:, at[:, 1]]) * LETTERS + inner[:, at[:, 2]]  # 16 bits are enough, and sort fast
            value = np.broadcast_to(weights, code.shape)
            if (odd := letters >= LETTERS).any():
                bad = (odd[:, at[:, 0]] | odd[:, at[:, 1]]) | odd[:, at[:, 2]]
                code[bad] = SIZE
                value = np.where(bad, 0.0, weights)
            order = code.argsort(1, kind="stable")
            ranked, sums = np.take_along_axis(code, order, 1), np.take_along_axis(value, order, 1).cumsum(1)
            last = np.ones(code.shape, bool)
            last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
            rows = np.repeat(np.arange(len(idx)), last.sum(1))
            ends = sums[last]
            new = np.ones(len(rows), bool)
            new[1:] = rows[1:] != rows[:-1]
            each = ends - np.where(new, 0.0, np.concatenate(([0.0], ends[:-1])))
            norm = np.sqrt(np.bincount(rows, each * each, len(idx)))
            yield idx, code, value / np.where(norm > 0, norm, 1.0)[:, None]


class Model(NamedTuple):
    """weights: of each subsequence, the sum over the landmarks; bias: of the margin; a, b, c: score = 1 / (1 + exp(-(a * best + b * second + c))), from the margins of a text's two best words, held in LEAST or 0 to MOST."""

    weights: np.ndarray
    bias: float
    a: float
    b: float
    c: float

    def margins(self, words: Sequence[bytes]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for idx, code, value in features(words):
            out[idx] += (self.weights[code] * value).sum(1)
        return out

    def margins_of(self, tokens: Sequence[bytes]) -> list[float]:
        """The margin of each token: the largest of its pieces."""
        parts = [pieces_of(t) for t in tokens]
        m = self.margins([p for x in parts for p in x]).tolist()
        out, at = [], 0
        for x in parts:
            out.append(m[at] if len(x) == 1 else max(m[at : at + len(x)]))
            at += len(x)
        return out

    def score(self, best: float, second: float) -> float:
        best, second = (min(max(m, least), MOST) for m, least in ((best, LEAST), (second, 0.0)))
        return float(1 / (1 + np.exp(-np.clip(self.a * best + self.b * second + self.c, -50, 50))))


def tokens_of(text: bytes | None) -> set[bytes]:
    """Distinct words of a text, and runs of single characters joined (w o r d)."""
    found: set[bytes] = set()
    for piece in _pieces(text or b""):
        piece = piece.lower()
        found.update(piece.split())
        found.update(x.replace(b" ", b"") for x in _SPACED.findall(piece))
    return found


def _newton(parts: Sequence[tuple[np.ndarray, float, np.ndarray]], ridge: float, steps: int = 25) -> np.ndarray:
    """Squared-hinge support vector machine, primal, by Newton steps; parts: rows, whose last column is 1, their sign and their weights."""
    width = parts[0][0].shape[1]
    w = np.zeros(width)
    for _ in range(steps):
        g, h = ridge * w, ridge * np.eye(width)
        for x, sign, weight in parts:
            for at in range(0, len(x), ROWS):
                rows = x[at : at + ROWS]
                slack = 1 - sign * (rows @ w)
                on = slack > 0
                rows, pull = rows[on], weight[at : at + ROWS][on]
                g -= sign * ((pull * slack[on]) @ rows)
                h += (rows * pull[:, None]).T @ rows
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Bag(bytes):
    """The distinct words of a text, as tokens_of() gives them, each on a line."""


def _numbered(texts: Sequence[bytes]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """All pieces of the texts, and for each text the numbers of its pieces of three characters or more, and of the first pieces of its words."""
    number: dict[bytes, int] = {}
    of_token: dict[bytes, tuple[int, ...]] = {}
    seen, heads = [], []
    for text in texts:
        mine: set[int] = set()
        first: set[int] = set()
        for t in text.split() if isinstance(text, Bag) else tokens_of(text):
            ids = of_token.get(t)
            if ids is None:
                if len(of_token) >= REMEMBERED:
                    of_token.clear()
                ids = tuple(number.setdefault(p, len(number)) for p in pieces_of(t))
                if len(t) <= LONGEST:
                    of_token[t] = ids
            mine.update(ids)
            first.add(ids[0])
        seen.append(np.fromiter(mine, np.int32, len(mine)))
        heads.append(np.fromiter(first, np.int32, len(first)))
    words = list(number)
    long = np.fromiter(map(len, words), np.int32, len(words)) >= 3
    return words, [ids[long[ids]] for ids in seen], heads


def train(texts: Sequence[bytes], labels: Sequence[int], rate: float | None = None) -> Model:
    """Learn from texts, or Bags of their words, marked as a whole: in a toxic text at least one word is, in a clean one none.

    The first witnesses of a toxic text are its words that stand SURE deviations more often in toxic texts than by chance, and PURITY times as often as in clean
    ones, or else its most over-represented word; then machine and witnesses (words of positive margin, or the best) are found in turn. Landmarks are the witnesses and words of clean texts, drawn by a hash. rate: the share of toxic texts
    among all, if the sample has another. Without texts of both classes every score is the rate.
    """
    y = np.array([int(v) for v in labels])
    prior = float(rate if rate is not None else y.mean() if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE + 1), 0.0, 0.0, 0.0, float(np.log(p / (1 - p))))
    words, seen, heads = _numbered(texts)
    in_toxic, in_clean = (np.bincount(np.concatenate([h for h, label in zip(heads, y, strict=True) if label == v]), minlength=len(words)) for v in (1, 0))
    del heads
    share = y.mean()
    expected = share * (in_toxic + in_clean)
    lift = np.where(in_toxic > 0, (in_toxic - expected) / np.sqrt(expected + 1), 0.0)
    by_word = np.argsort(np.array(words, object), kind="stable")  # ties go to the greater word
    place = np.empty(len(words), np.int64)
    place[by_word] = np.arange(len(words))

    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    pure = in_toxic * n_clean >= PURITY * in_clean * n_toxic

    def witnesses(value, least):
        """In how many toxic texts each word is a witness: all of a text's pure words of that value, or its best word if it has none."""
        found: Counter = Counter()
        for ids, label in zip(seen, y, strict=True):
            if label and len(ids):
                sure = ids[pure[ids] & (value[ids] >= least)]
                found.update(sure.tolist() if len(sure) else [int(ids[np.lexsort((place[ids], value[ids]))[-1]])])
        return Counter({words[i]: n for i, n in found.items()})

    counts = witnesses(lift, SURE)
    clean = Counter({words[i]: int(in_clean[i]) for i in np.flatnonzero(in_clean)})
    negatives = sorted((w for w in clean if len(w) >= 3), key=lambda w: (-min(clean[w], 20), zlib.crc32(w)))[:NEGATIVES]
    best = [w for w, _ in counts.most_common(LANDMARKS // 2)]
    marks = list(dict.fromkeys(best + sorted(negatives, key=zlib.crc32)[: LANDMARKS - len(best)]))
    dense = np.zeros((len(marks), SIZE + 1))
    for idx, code, value in features(marks):
        np.add.at(dense, (idx[:, None], code), value)
    dense[:, SIZE] = 0
    values, vectors = np.linalg.eigh(dense @ dense.T)
    good = values > 1e-6
    # rows: subsequences, columns: Nyström coordinates
    by_code = dense.T @ (vectors[:, good] / np.sqrt(values[good]))
    del dense

    def coordinates(words):
        out = np.zeros((len(words), by_code.shape[1] + 1))
        out[:, -1] = 1
        for idx, code, value in features(words):
            for a in range(0, len(idx), 16):
                out[idx[a : a + 16], :-1] = np.einsum("wt,wtm->wm", value[a : a + 16], by_code[code[a : a + 16]])
        return out

    low = coordinates(negatives)
    rare = np.array([min(clean[w], 20) for w in negatives], float)
    model = None
    for _ in range(ROUNDS):
        high = list(counts)
        often = np.array([counts[w] * counts[w] / (counts[w] + clean[w]) for w in high], float)
        w = _newton([(coordinates(high), 1.0, POSITIVE * often), (low, -1.0, rare)], ridge=1.0)
        direction = by_code @ w[:-1]
        direction[SIZE] = 0.0
        model = Model(direction, float(w[-1]), 1.0, 0.0, 0.0)
        margin = model.margins(words)
        counts = witnesses(margin, 0.0)
    two = np.array([(np.unique(margin[ids])[::-1].tolist() + [model.bias] * 2)[:2] for ids in seen])
    a, b, c = _logistic(np.c_[two[:, 0].clip(LEAST, MOST), two[:, 1].clip(0, MOST), np.ones(len(two))], y)
    c += np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0.0
    return model._replace(a=float(a), b=float(b), c=float(c))


def bags(text: Column) -> Column:
    """Bag of each whole text."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([b"\n".join(sorted(tokens_of(v.as_py()))) for v in batch.cast(pa.large_binary())], pa.binary())

    return of(text)


def sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, texts: int = TRAIN_TEXTS) -> tuple[list[Bag], list[int], float]:
    """Words of whole texts, and labels, to learn from, at most `texts` of each class, those of the smallest hashes of their id; and the share of toxic
    rows among all that are usable. usable: condition on id. Ids with several labels are toxic if one is; null ids, labels and texts are left out. Only words come to the driver."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    told = told if usable is None else told.where(usable)
    rate = told.agg(F.avg("y")).first()[0]
    turn = F.xxhash64("id")
    drawn = [told.where(F.col("y") == y).orderBy(turn, "id").limit(2 * texts) for y in (0, 1)]
    few = F.broadcast(drawn[0].union(drawn[1]))  # 4 * texts rows of two numbers at most
    known = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).join(few, "id")
    kept = []
    for y in (0, 1):
        chosen = known.where(F.col("y") == y).orderBy(turn, "id", F.xxhash64("t")).limit(texts)
        kept += [(Bag(r.w), y) for r in chosen.select(bags(F.col("t")).alias("w")).collect()]
    return [w for w, _ in kept], [y for _, y in kept], float(rate or 0.0)


def toxicity(text: Column, model: Model) -> Column:
    """Score (0 to 1) of each whole text; null counts as empty, and that has the score of no word at all. Words met before are not scored again."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, float] = {}

        def scored(bags: list[set[bytes]]) -> list[float]:
            new = [t for t in set().union(*bags) if t not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set().union(*bags))
            long = [t for t in new if len(t) > LONGEST]
            known.update(zip(new, model.margins_of(new), strict=True))
            best = [sorted({known[t] for t in bag}, reverse=True)[:2] + [model.bias] * 2 for bag in bags]
            for t in long:
                del known[t]
            return [model.score(b[0], b[1]) for b in best]

        for batch in batches:
            out, bags, size = [], [], 0
            for value in batch.cast(pa.large_binary()):
                text = value.as_py()
                bags.append(tokens_of(text))
                size += len(text or b"")
                if size >= TOGETHER:
                    out += scored(bags)
                    bags, size = [], 0
            yield pa.array(out + scored(bags), pa.float64())

    return score(text)
