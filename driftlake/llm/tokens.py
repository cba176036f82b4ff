"""Token counts: whole texts through a public tokenizer, lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that one encoding call gets at most, unless a single word is longer.
CALL_BYTES = 1 << 20
#: Words whose count a task remembers, in each of two generations (when the young one is full, it is the old one), and the bytes of the longest of these: some 100 MB in all.
REMEMBERED, LONGEST = 300_000, 64
#: What a tokenizer does to a text first, where white space is a safe boundary. Any other leaves texts whole.
SAFE_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
SAFE_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")

_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def _json_counter(path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _model_counter(path: str) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]


def _drops_white_space(path: str) -> bool:
    """Whether the tokenizer takes nothing from white space and never joins what stands on its two sides.

    True only for a tokenizer whose normalizers are among SAFE_NORMALIZERS, whose pre-tokenizer begins by keeping the matches of one of SAFE_PATTERNS, none of
    which holds white space, and removing the rest, and whose added tokens neither hold nor strip white space: then a text's tokens are those of its
    words, one after the other.
    """
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    normal = d.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    pre = d.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and (first.get("pattern") or {}).get("Regex") in SAFE_PATTERNS
    plain = all(not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in d.get("added_tokens", []))
    return split and plain and all(step in SAFE_NORMALIZERS for step in steps) and not d.get("post_processor")


def _pieces(text: bytes) -> Iterator[bytes]:
    """text, cut before ASCII white space into pieces of about CALL_BYTES."""
    at = 0
    while len(text) - at > CALL_BYTES:
        blank = _BLANK.search(text, at + CALL_BYTES)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _by_bytes(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about CALL_BYTES together."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CALL_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class Counts:
    """Tokens of words, as far as they are remembered: in two generations, so that words met again and again stay."""

    def __init__(self, count: Callable[[list[str]], list[int]]):
        self.count = count
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encoded(self, texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for run in _by_bytes(texts):
            out += self.count([t.decode() for t in run])
        return out

    def of(self, words: set[bytes]) -> dict[bytes, int]:
        """The count of each of the words."""
        found, new = {}, []
        for w in words:
            n = self.young.get(w)
            if n is None:
                n = self.old.get(w)
                if n is None:
                    new.append(w)
                    continue
                self.young[w] = n
            found[w] = n
        counted = dict(zip(new, self.encoded(new), strict=True))
        found.update(counted)
        self.young.update((w, n) for w, n in counted.items() if len(w) <= LONGEST)
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        return found


def counter(path: str) -> Counts:
    count = _COUNTERS.get(path)
    if count is None:
        count = _COUNTERS[path] = (_json_counter if path.endswith(".json") else _model_counter)(path)
    return Counts(count)


def count_texts(texts: list[bytes | None], known: Counts, split: bool) -> list[int]:
    """Number of tokens of each text (null: 0). split: white space is a safe boundary, so each distinct word of the texts is encoded once."""
    if not split:
        return known.encoded([t or b"" for t in texts])
    sums = [0] * len(texts)
    held: list[tuple[int, list[bytes]]] = []
    size = 0

    def settle():
        found = known.of(set().union(*(words for _, words in held)))
        for i, words in held:
            sums[i] += sum(map(found.__getitem__, words))
        held.clear()

    for i, t in enumerate(texts):
        for piece in _pieces(t or b""):
            held.append((i, piece.split()))
            size += len(piece)
            if size >= CALL_BYTES:
                settle()
                size = 0
    if held:
        settle()
    return sums


def token_lengths(text: Column, path: str) -> Column:
    """Number of tokens of each whole text as the library for path gives them (.json: tokenizers, .model: sentencepiece).

    No begin, end or added special tokens, no truncation, no padding; special strings inside a text are handled as the library does by
    default. Null and empty texts have 0 tokens. Where the tokenizer drops white space, texts are cut there: the pieces of a long text
    are counted one by one, and words that a worker has met are not encoded again. Elsewhere there is no boundary that is safe for every
    text, so texts stay whole. Only lengths leave the Python worker. path must exist on every machine.
    """

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, split = counter(path), _drops_white_space(path)
        for batch in batches:
            out: list[int] = []
            run: list[bytes | None] = []
            size = 0
            for value in batch.cast(pa.large_binary()):
                run.append(value.as_py())
                size += len(run[-1] or b"")
                if size >= CALL_BYTES:
                    out += count_texts(run, known, split)
                    run, size = [], 0
            yield pa.array(out + count_texts(run, known, split), pa.int64())

    return lengths(text)
