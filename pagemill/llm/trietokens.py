"""Token counts by unigram segmentation, with forward scores shared along a trie of pre-tokens.

Distinct pre-tokens enter a trie; the best score and token count after each character are computed
once per trie node, and the count at a word's last node is stored. Walking the words in sorted order
visits the trie depth first, so only the current path is held. Work stays inside a task: nothing is
shuffled. The vocabulary is a sentencepiece file; the log-probability of a piece follows Zipf's law
on its place in the file.

Defined results: null or empty text has no pre-tokens; characters outside the vocabulary count one
token per UTF-8 byte; of equal scores the segmentation with the longest last piece counts; repeated
rows are counted each; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.llm.text import boxed, chunks, text_of

#: Fixed value: the mark that stands for a word's leading space.
MARK = "▁"
BYTE_PENALTY = 10.0
MEMO = 400_000
_PIECES: dict[str, tuple[dict[str, float], int]] = {}


def pieces(path: str) -> tuple[dict[str, float], int]:
    """Scores of the pieces that stand for text, and the longest piece's length."""
    if path not in _PIECES:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        total = log(sum(1.0 / (k + 2) for k in range(len(plain))))
        scores = {model.id_to_piece(i): -log(k + 2) - total for k, i in enumerate(plain)}
        _PIECES[path] = scores, max(map(len, scores), default=1)
    return _PIECES[path]


def terminal_counts(words: Iterable[str], scores: dict[str, float], longest: int) -> dict[str, int]:
    """Tokens of the best segmentation of each distinct word."""
    worst = min(scores.values(), default=0.0) - BYTE_PENALTY
    path, best, tokens, out = "", [0.0], [0], {}
    get = scores.get
    for word in sorted(words):
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, count = None, 0
            for start in range(max(0, end - longest), end):
                piece = get(word[start:end])
                if piece is not None and (top is None or best[start] + piece > top):
                    top, count = best[start] + piece, tokens[start] + 1
            if top is None:
                size = len(word[end - 1].encode())
                top, count = best[end - 1] + worst * size, tokens[end - 1] + size
            best.append(top)
            tokens.append(count)
        path, out[word] = word, tokens[-1]
    return out


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """id, n_words and n_tokens of every row."""
    frame = boxed(docs, id=F.col(key), text=text_of()).select("id", "text")
    kind = frame.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = pieces(vocabulary)
        known: dict[bytes, int] = {}
        for keys, texts in chunks(batches, "id", "text", 6_000_000):
            runs = [t.split() for t in texts]
            new = {w for run in runs for w in run if w not in known}
            counts = terminal_counts((MARK + w.decode() for w in new), scores, longest)
            known.update((w, counts[MARK + w.decode()]) for w in new)
            totals = [sum(map(known.__getitem__, run)) for run in runs]
            columns = [pa.array(keys, arrow), pa.array(map(len, runs), pa.int64()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_tokens"])
            if len(known) > MEMO:
                known.clear()

    return frame.mapInArrow(each, f"id {kind.simpleString()}, n_words long, n_tokens long")
