"""Quality rules: repeated substrings of a text found with a word suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, whole_text

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Texts are joined into blocks of about so many words; a longer text is a block of its own.
BLOCK_WORDS = 50_000
#: Ranks kept of a block; of a longer one only those after 1, 2 and the least repeat's words are.
KEPT_RANKS = 4_000_000

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    A text fails with under ``min_words`` words, with more than ``max_repeat_share`` of its words in
    3-word windows that recur, with more than ``max_covered_share`` of them under repeats of at least
    ``min_repeat_words`` words, or with one repeat of over ``max_longest_words`` words. Shorter repeats, like a
    license line that stands twice, are left to line dedup.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    min_repeat_words: int = 16
    max_covered_share: float = 0.25
    max_longest_words: int = 100


def suffix_levels(code: np.ndarray, end: np.ndarray, start_rank: np.ndarray, wanted: set[int]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Suffix array by prefix doubling, with the ranks after 1, 2, 4, ... words.

    Once the ranks kept exceed KEPT_RANKS, those after ``2 ** k`` words for a k not ``wanted`` are given up (None).

    ``end[i]`` is where the text of position i ends, so texts of a block stay apart; ``start_rank`` orders
    the first words and differs between texts. A rank is the place of the first suffix with the same
    prefix; suffixes whose prefix is unique are left out of later rounds.
    """
    n = len(code)
    order = np.argsort(start_rank, kind="stable")
    value = start_rank[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, h = [rank], 1
    place = np.arange(n)
    active = _tied(first)
    while active.any():
        at = place[active]
        mine = order[at]
        ahead = mine + h
        follow = np.where(ahead < end[mine], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[mine] * (n + 2) + follow
        by = np.argsort(key, kind="stable")
        mine, key = mine[by], key[by]
        order[at] = mine
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[mine] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank)
        if len(levels) * n > KEPT_RANKS:
            levels = [x if k in wanted else None for k, x in enumerate(levels)]
        place, active = at, _tied(new)
        h *= 2
    return order, levels


def _tied(first: np.ndarray) -> np.ndarray:
    """True for members of groups of two or more, given where groups begin."""
    return ~(first & np.concatenate([first[1:], [True]]))


def common_prefixes(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that the suffixes at i and j share, by halving steps down the ranks."""
    n = len(levels[0])
    shared = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + shared, j + shared
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]) & (a != b)
        shared += same << k
    return shared


def neighbour_prefixes(order: np.ndarray, code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that each suffix but the first of ``order`` shares with the one before it, in one walk along the text.

    A suffix shares at least all but one of the words that the suffix a word earlier did, so the walk compares each word
    at most twice and needs no ranks.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words, ends, shared = memoryview(code), memoryview(end), np.zeros(n, np.int64)
    known = 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            known = 0
            continue
        room = min(ends[i] - i, ends[j] - j)
        while known < room and words[i + known] == words[j + known]:
            known += 1
        shared[i] = known
        known = max(0, known - 1)
    return shared[order[1:]]


def repeats(lengths: np.ndarray, code: np.ndarray, min_repeat_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of a block: words in recurring 3-word windows, words under long repeats, longest repeat.

    Neighbours in the suffix array share their longest common prefix; the deepest prefix interval that
    holds a suffix has the larger of its two. Its occurrences are the maximal repeated substrings, and
    the union of their spans is what they cover.
    """
    n, texts = len(code), len(lengths)
    if not n:
        return (np.zeros(texts, np.int64),) * 3
    stop = np.cumsum(lengths)
    text = np.repeat(np.arange(texts), lengths)
    end = stop[text]
    least = max(0, min_repeat_words.bit_length() - 1)
    order, levels = suffix_levels(code, end, text * (int(code.max()) + 1) + code, {0, 1, least})
    at = np.arange(n)

    pairs = levels[1] if len(levels) > 1 else levels[0] + at * 0
    whole = at[at + 2 < end]
    tied = np.bincount(pairs, minlength=n)[pairs[whole]] > 1 if len(levels) > 1 else np.zeros(len(whole), bool)
    whole = whole[tied]
    _, group, count = np.unique(pairs[whole] * (n + 1) + levels[0][whole + 2], return_inverse=True, return_counts=True)
    windows = _covered(whole[count[group] > 1], np.full(int((count[group] > 1).sum()), 3), n)

    i, j = order[:-1], order[1:]
    if any(x is None for x in levels):
        shared = neighbour_prefixes(order, code, end)
    else:
        coarse = min(len(levels) - 1, least)
        near = levels[coarse][i] == levels[coarse][j]
        i, j = i[near], j[near]
        shared = common_prefixes(i, j, levels)
    deep = np.zeros(n, np.int64)
    np.maximum.at(deep, i, shared)
    np.maximum.at(deep, j, shared)
    long = np.nonzero(deep >= min_repeat_words)[0]
    spans = _covered(long, deep[long], n)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, text, deep)
    return (
        np.bincount(text, weights=windows, minlength=texts).astype(np.int64),
        np.bincount(text, weights=spans, minlength=texts).astype(np.int64),
        np.where(longest >= min_repeat_words, longest, 0),
    )


def _covered(start: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    """1 where a position lies under one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for a batch of texts."""
    n_words, features, block, held = [], [], [], 0

    def flush() -> None:
        nonlocal block, held
        if block:
            flat = pa.array([w for words in block for w in words], pa.binary()).dictionary_encode()
            features.append(repeats(np.array([len(w) for w in block]), flat.indices.to_numpy().astype(np.int64), rules.min_repeat_words))
        block, held = [], 0

    chars, symbols, dup_lines = [], [], []
    for t in texts:
        words = t.encode("utf-8", "replace").split()
        if held and held + len(words) > BLOCK_WORDS:
            flush()
        block.append(words)
        held += len(words)
        n_words.append(len(words))
        chars.append(len(t) - sum(map(t.count, SPACES)))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        dup_lines.append(len(lines) - len(set(lines)))
    flush()
    out = {"n_words": np.array(n_words, np.int64), "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64)}
    for k, name in enumerate(("n_repeat_words", "n_covered_words", "longest_repeat")):
        out[name] = np.concatenate([f[k] for f in features]) if features else np.zeros(0, np.int64)
    n = out["n_words"]
    out["base_failed"] = (n < rules.min_words) | (out["n_repeat_words"] > rules.max_repeat_share * n)
    out["kept"] = ~out["base_failed"] & (out["n_covered_words"] <= rules.max_covered_share * n) & (out["longest_repeat"] <= rules.max_longest_words)
    return out


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def score_quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the columns of COLUMNS, one row per row of ``docs``.

    A null or empty text has no words and fails. Repeated rows get equal results; an empty table gives none.
    Other columns are not read. A column of COLUMNS that is named like ``id_col`` gets an underscore. Each text is measured
    whole, on its own, in the task that reads it.
    """
    columns = ", ".join(f"{n}_ {t}" if n.lower() == id_col.lower() else f"{n} {t}" for n, t in (c.split() for c in COLUMNS.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            found = measure(_texts(part.column(1)), rules)
            yield pa.record_batch([part.column(0), *(pa.array(found[c.split()[0]]) for c in COLUMNS.split(", "))], names=[id_col, *(c.split()[0] for c in columns.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def keep_quality(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, at):
            yield part.filter(pa.array(measure(_texts(part.column(at)), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
